"""Case files and status rows derived from general tables, so that queries have inputs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import sql
from casegraph.functions.dates import utc_stamp
from casegraph.schemas import CERTIFICADO, IDENTIDAD, SOLICITUD, struct_ddl

CASE_SIZE = 10
GIVEN = ("Ana", "José", "Lucía", "Iñés")
FATHER = ("García", "Núñez", "Pérez")
PARENT, OTHER_PARENT, GRANDPARENT = "Pedro Ruiz", "María Díaz", "Carlos Ruiz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over as many partitions as there are cores, if a small file has them in fewer: what is made of a key is much
    larger than the key."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def stage_of(event: Column) -> Column:
    return F.when(event == "error", "FAILED").when(event == "click", "RECEIVED").otherwise("OCR_DONE")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows: every five events are a case."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    stage = stage_of(F.col("event_type"))
    return e.select(
        F.expr("event_id div 5").cast("string").alias("case_id"), F.col("event_id").cast("string").alias("document_id"), stage.alias("stage"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt_count"), utc_stamp(F.col("ts")).alias("last_updated"),
        F.when(stage == "FAILED", F.concat(F.lit("error "), F.col("event_id") % 7)).alias("error_detail"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested transitions: the events of a user are one document's."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    user = F.col("user_id").cast("string")
    return e.select(
        F.expr("user_id div 5").cast("string").alias("case_id"), user.alias("document_id"), F.col("event_id").alias("seq"), stage_of(F.col("event_type")).alias("target"),
        F.concat(F.lit("error "), F.col("event_id") % 7).alias("error_detail"), utc_stamp(F.col("ts")).alias("moment"),
    )


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def case_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records: every ten orders are a case file, its scenario the last digit of the case.

    0 clean, 1 no second certificates, 2 identity document expired, 3 application undated, 4 two applicants, 5 two birth
    dates, 6 parent too young, 7 a number shared by two names, 8 no third generation, 9 applicant's certificates
    without generation.
    """
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).selectExpr(f"o_orderkey div {CASE_SIZE} as c", f"int(o_orderkey % {CASE_SIZE}) as k")
    pick = lambda values: f"get({sql.texts(values)}, int(c div 10 % {len(values)}))"
    o = o.selectExpr("c", "k", "int(c % 10) as v", f"{pick(GIVEN)} as given", f"{pick(FATHER)} as father")
    number = lambda n: f"concat('{n}-', c)"
    q, when = sql.quoted, sql.case
    doc = "get(array('a', 'b', 'c1', 'c2', 'c3', 'd1', 'd2', 'd3', 'o', 'z'), k)"
    kind = when(("k = 0", "'APPLICATION'"), ("k = 1", "'ID_DOCUMENT'"), ("(v = 1 and k in (5, 6, 7)) or (v = 8 and k in (4, 7)) or k = 8", "'OTHER'"), ("k = 9", "'EMPTY'"), other="'BIRTH_CERT'")
    o = o.selectExpr("*", f"{doc} as doc", f"{kind} as kind")
    generation = "if(kind = 'BIRTH_CERT' and not (v = 9 and k in (2, 5)), concat('G', (k - 2) % 3 + 1), null)"

    form = dict.fromkeys(SOLICITUD, "'dato'") | {
        "nombre_solicitante": "given", "apellido_padre": "father", "apellido_madre": "''", "nacionalidad": "'Boliviana'", "numero_id": number(1), "fecha_presentacion": "'01/Octubre/2025'",
    }
    acroform = sql.entries({SOLICITUD[a]: x for a, x in form.items()})
    acroform = f"if(v = 3, map_filter({acroform}, (key, x) -> key <> {q(SOLICITUD['fecha_presentacion'])}), {acroform})"
    identity = dict.fromkeys(IDENTIDAD, "'dato'") | {
        "nombres": "upper(given)", "apellidos": "upper(father)", "nacionalidad": "'BOLIVIANA'", "numero_id": "concat('1.', c)",
        "fecha_nacimiento": "'01/01/1990'", "fecha_vencimiento": "if(v = 2, '01/01/2020', '01/01/2030')",
    }
    # without named grandparents nothing but a name ties the third generation together, and no flag of low confidence arises
    grand = lambda x: f"if(v in (0, 6, 9), '', {x})"
    three = lambda x, y, z: when(("k in (2, 5)", x), ("k in (3, 6)", y), other=z)
    stranger = lambda x, y: f"if(v = 4 and k = 5, {q(x)}, {y})"
    born = three(stranger("01/01/1970", "if(v = 5 and k = 5, '05/05/1990', '1 de enero de 1990')"), "if(v = 6, '01.01.1985', '01 ENERO MIL NOVECIENTOS SESENTA')", "'1930-01-01'")
    certificate = dict.fromkeys(CERTIFICADO, "'dato'") | {
        "nombre": three(stranger("Luis Torres", "concat_ws(' ', given, father)"), q(PARENT), q(GRANDPARENT)), "fecha_nacimiento": born, "lugar_inscripcion": "'La Paz / Bolivia'",
        "progenitor1_nombre": three(q(PARENT), grand(q(GRANDPARENT)), "'Juan Ruiz'"), "progenitor2_nombre": three(q(OTHER_PARENT), grand(q(GRANDPARENT)), "'Rosa Gil'"),
        "progenitor1_num_doc": three(f"if(v = 7, {number(1)}, {number(2)})", grand(number(3)), number(5)), "progenitor2_num_doc": three(number(4), grand(number(3)), number(6)),
        "progenitor1_nacionalidad": three("'ESP'", grand("'ESP'"), "'ESP'"), "progenitor2_nacionalidad": three("'Española'", grand("'Española'"), "'Española'"),
    }
    none = "cast(map() as map<string,string>)"
    fields = when(("kind = 'ID_DOCUMENT'", sql.entries(identity)), ("kind = 'BIRTH_CERT'", sql.entries(certificate)), other=none)
    extraction = {
        "file_type": "'pdf'", "extracted_text": "'texto'", "page_count": "1", "pages_via_text_layer": "1", "pages_via_vlm": "0", "orientation_corrections": none,
        "acroform_fields": f"if(k = 0, {acroform}, {none})", "xfa_fields": none,
    }
    classification = {"document_type": "kind", "generation": generation, "confidence": "1.0d", "raw_response": "''"}
    return o.selectExpr(
        "string(c) as case_id", "doc as document_id", "concat(doc, '.pdf') as source_file", f"{sql.struct(extraction)} as extraction", f"{sql.struct(classification)} as classification",
        f"named_struct('fields', {fields}, 'raw_response', '') as field_extraction", "k / 4 as processing_seconds", "'stub' as model_name", "'2025-01-01T00:00:00Z' as extracted_at",
    )


def identity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical identity documents: a customer's orders are the documents of a case, whose names, births and numbers agree
    more or less, and are absent here and there."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    given, father = (f"get({sql.texts(v)}, int(({k}) % {len(v)}))" for v, k in ((GIVEN, "o_custkey + int(o_orderkey % 11 = 0)"), (FATHER, "o_orderkey div 4")))
    name = sql.case(("o_orderkey % 5 = 0", given), ("o_orderkey % 5 = 1", father), ("o_orderkey % 5 = 4", "''"), other=f"concat_ws(' ', {given}, {father})")
    values = dict.fromkeys(IDENTIDAD, "null") | {
        "nombres": name, "numero_id": "if(floor(o_totalprice) % 3 = 0, '', concat('n-', floor(o_totalprice) % 7 % 2))", "nacionalidad": "get(array('ESP', 'Española', '', ''), int(o_orderkey % 4))",
        "fecha_nacimiento": "if(o_orderkey % 3 = 0, null, date_format(o_orderdate, 'dd/MM/yyyy'))",
    }
    none = (f"cast(null as {struct_ddl(x)}) as {n}" for n, x in (("solicitud", SOLICITUD), ("certificado", CERTIFICADO)))
    return o.selectExpr("string(o_custkey) as case_id", "lpad(string(o_orderkey), 12, '0') as document_id", "cast(null as string) as generation", f"cast({sql.struct(values)} as {struct_ddl(IDENTIDAD)}) as identidad", *none)


def case_status_rows(extractions: DataFrame) -> DataFrame:
    """Status rows of case files that are all done."""
    return extractions.select("case_id", "document_id", F.lit("OCR_DONE").alias("stage"), F.lit(1).alias("attempt_count"), F.col("extracted_at").alias("last_updated"), F.lit(None).cast("string").alias("error_detail"))


def person_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two person records a row, with names, numbers and dates in different spellings, from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = F.col("o_orderkey")
    name = F.concat_ws(" ", _pick(GIVEN, n), _pick(FATHER, n))
    other = F.when(n % 5 == 0, F.upper(name)).when(n % 5 == 1, _pick(GIVEN, n)).when(n % 5 == 2, F.concat(_pick(FATHER, n), F.lit("  "), _pick(GIVEN, n))).when(n % 5 == 3, "Luis Torres")
    return o.select(
        n.alias("id"), name.alias("a_name"), other.alias("b_name"),
        F.concat(F.lit("ab-"), n % 9).alias("a_number"), F.concat(F.lit("A.B "), n % 4).alias("b_number"),
        F.to_date("o_orderdate").alias("a_born"), F.when(n % 11 != 0, F.date_add(F.to_date("o_orderdate"), (n % 1500).cast("int"))).alias("b_born"),
        F.when(n % 3 == 0, "ESP").when(n % 3 == 1, " española ").otherwise("Boliviana").alias("a_nation"),
    )


# Names of the months, for dates in words.
MONTH_NAMES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

# Number words, by their digit.
ONES = ("", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve")
DECADES = ("", "diez", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa")
CENTURIES = ("", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos", "ochocientos", "novecientos")


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, written, real: order dates in eight forms, one of them with the year in words, one no date."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("real"))
    d, n = F.col("real"), F.col("id")
    month = F.get(F.array(*map(F.lit, MONTH_NAMES)), F.month(d) - 1)
    word = F.concat_ws(" ", F.date_format(d, "dd"), F.upper(month), F.date_format(d, "yyyy"))
    ones, tens, hundreds = (_pick(words, F.expr(f"year(real) div {10**k} % 10")) for k, words in enumerate((ONES, DECADES, CENTURIES)))
    below = F.when(F.year(d) % 10 == 0, tens).when(F.year(d) % 100 < 10, ones).otherwise(F.concat_ws(" y ", tens, ones))
    thousands = F.when(F.year(d) < 2000, F.lit("mil")).otherwise(F.lit("dos mil"))
    spelled = F.concat_ws("  ", F.day(d).cast("string"), month, F.concat_ws(" ", thousands, F.nullif(hundreds, F.lit("")), F.nullif(below, F.lit(""))))
    written = (
        F.when(n % 8 == 0, F.date_format(d, "dd/MM/yyyy")).when(n % 8 == 1, F.date_format(d, "d-M-yyyy")).when(n % 8 == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(n % 8 == 3, F.date_format(d, " dd.MM.yyyy ")).when(n % 8 == 4, F.concat_ws(" de ", F.day(d).cast("string"), month, F.year(d).cast("string")))
        .when(n % 8 == 5, word).when(n % 8 == 7, spelled).otherwise(F.date_format(d, "MMMM d, yyyy"))
    )
    return o.select("id", written.alias("written"), "real")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, reply: model replies of several kinds, exact, wordy, wrong and with a generation."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    n = F.col("id")
    reply = (
        F.when(n % 6 == 0, "APPLICATION").when(n % 6 == 1, "The type is: id_document.").when(n % 6 == 2, F.concat(F.lit("\nBIRTH_CERT\n generation g"), n % 4))
        .when(n % 6 == 3, "no idea").when(n % 6 == 4, "\n\n").otherwise("OTHER\nG1")
    )
    return d.select("id", reply.alias("reply"))


def dirty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: whole texts, some within code fences, image links and page headers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, t = F.col("doc_id"), F.col("text")
    fenced = F.concat(F.lit("```markdown\n"), t, F.lit("\n```"))
    headed = F.concat(F.lit("--- Page 1 (text) ---\n"), t)
    return d.select("doc_id", F.when(n % 3 == 0, fenced).when(n % 3 == 1, F.concat(F.lit("![x](a.png)"), t)).otherwise(headed).alias("text"))

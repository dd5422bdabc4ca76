"""Registered queries over tables, files, forms and model replies, each with SQL that tells the same rows another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.text import form_block, is_safe_id, is_safe_name, nfc, slug
from casegraph.operators import adapter, decision, engine, lineage, replies, report, status
from casegraph.sources import derived, files, results
from casegraph.sources.shared import shared_dir
from casegraph.sources.store import Store

STAGE = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RECEIVED' ELSE 'OCR_DONE' END"
STATUS = f"""s AS (
  SELECT CAST(event_id // 5 AS VARCHAR) AS case_id, CAST(event_id AS VARCHAR) AS document_id, event_id, {STAGE} AS stage,
    CAST(event_id % 3 + 1 AS INTEGER) AS attempt_count, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
    CASE WHEN event_type = 'error' THEN 'error ' || (event_id % 7) END AS error_detail FROM events)"""


def _store(spark: SparkSession) -> Store:
    """Tables of one query, in the shared folder."""
    return Store(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", lambda: F.lit("2025-06-01T00:00:00Z"))


def extraction_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records put into the tables twice, those of every other document with more seconds the second time."""
    store, rows = _store(spark), derived.case_extractions(spark, sf_dir)
    store.put_extractions(rows)
    store.put_extractions(rows.where("cast(processing_seconds * 4 as int) % 2 = 0").withColumn("processing_seconds", F.col("processing_seconds") + 1))
    got = store.extractions()
    return got.select("case_id", "document_id", "source_file", "processing_seconds", F.col("classification.document_type").alias("document_type"), F.size("field_extraction.fields").alias("fields"))


_CASES = """o AS (SELECT o_orderkey // 10 AS c, o_orderkey % 10 AS k, (o_orderkey // 10) % 10 AS v FROM orders),
d AS (
  SELECT CAST(c AS VARCHAR) AS case_id, ['a', 'b', 'c1', 'c2', 'c3', 'd1', 'd2', 'd3', 'o', 'z'][k + 1] AS document_id, c, k, v,
    CASE WHEN k = 0 THEN 'APPLICATION' WHEN k = 1 THEN 'ID_DOCUMENT' WHEN k = 9 THEN 'EMPTY' WHEN k = 8 OR (v = 1 AND k IN (5, 6, 7)) OR (v = 8 AND k IN (4, 7)) THEN 'OTHER' ELSE 'BIRTH_CERT' END AS document_type
  FROM o)"""
EXTRACTION_LATEST = f"""WITH {_CASES}
SELECT case_id, document_id, document_id || '.pdf' AS source_file, k / 4 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS processing_seconds, document_type,
  CAST(CASE document_type WHEN 'ID_DOCUMENT' THEN 9 WHEN 'BIRTH_CERT' THEN 13 ELSE 0 END AS INTEGER) AS fields FROM d"""


def case_verdict_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's answer for each case file, its snapshot written and read back: of every seven cases one has a failed
    document, and one a document that isn't done."""
    store, rows = _store(spark), derived.case_extractions(spark, sf_dir)
    store.put_snapshots(report.snapshots(decision.verdicts(adapter.canonical_documents(rows))))
    c = F.col("case_id").cast("long") % 7
    state = derived.case_status_rows(rows).withColumn("stage", F.when((c == 5) & (F.col("document_id") == "a"), "FAILED").when((c == 6) & (F.col("document_id") == "b"), "RECEIVED").otherwise("OCR_DONE"))
    snaps = store.snapshots().where(~c.isin(5, 6))
    told = engine.full_verdicts(state, rows, snaps, check=False)
    return told.select(
        "case_id", "result", "case_status", "estado", F.array_join(F.transform("failed", lambda f: f["name"]), ",").alias("failed"), F.array_join("pending", ",").alias("pending"),
        F.array_join(F.transform("issues", lambda i: i["code"]), "|").alias("issues"), F.size(F.filter("s1", lambda x: x["present"])).alias("present"), F.size("docs").alias("docs"), "total_seconds", "justification_en",
    )


_WEAK = "GENERACION_INFERIDA_BAJA_CONFIANZA"
CASE_VERDICT_FULL = f"""WITH c AS (SELECT o_orderkey // 10 AS c, (o_orderkey // 10) % 10 AS v, count(*) AS n, round(sum(o_orderkey % 10 / 4), 1) AS s FROM orders GROUP BY 1, 2),
p AS (SELECT *, c % 7 < 5 AS told, CASE WHEN v IN (2, 4, 5, 7) THEN 'ROJO' WHEN v IN (1, 3, 8) THEN 'AMARILLO' ELSE 'VERDE' END AS e FROM c)
SELECT CAST(c AS VARCHAR) AS case_id, CASE c % 7 WHEN 5 THEN 'failed' WHEN 6 THEN 'pending' ELSE 'verdict' END AS result,
  CASE c % 7 WHEN 5 THEN 'FAILED' WHEN 6 THEN 'RECEIVED' ELSE 'RULES_EVALUATED' END AS case_status, CASE WHEN told THEN e END AS estado,
  CASE WHEN c % 7 = 5 THEN 'a' END AS failed, CASE WHEN c % 7 = 6 THEN 'b' END AS pending,
  CASE WHEN told THEN CASE v WHEN 1 THEN '{_WEAK}' WHEN 2 THEN 'DOCUMENTO_VENCIDO|{_WEAK}' WHEN 3 THEN 'DOCUMENT_INCOMPLETE|FECHA_PRESENTACION_FALTANTE|{_WEAK}' WHEN 4 THEN 'NOMBRE_AMBIGUO|{_WEAK}'
    WHEN 5 THEN 'FECHA_CONFLICTO|{_WEAK}' WHEN 7 THEN 'DOCUMENTO_CRUZADO|{_WEAK}' WHEN 8 THEN 'FALTANTE: Certificado de Nacimiento Español de origen' ELSE '' END END AS issues,
  CAST(CASE WHEN told THEN CASE WHEN v = 8 THEN 4 ELSE 5 END END AS INTEGER) AS present, CAST(CASE WHEN told THEN n END AS INTEGER) AS docs, CASE WHEN told THEN s END AS total_seconds,
  CASE WHEN told THEN CASE e WHEN 'ROJO' THEN 'Conflicts were found that prevent automatic validation of the case.' WHEN 'AMARILLO' THEN 'The case needs manual review: documents are missing or there are minor remarks.'
    ELSE 'The case passes all automatic checks with no remarks.' END END AS justification_en FROM p"""


def transition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes of one request for each document of the status table, some for documents that aren't there."""
    store, rows = _store(spark), derived.status(spark, sf_dir)
    store.append("status", rows)
    n = F.col("document_id").cast("long")
    asked = rows.select(
        "case_id", F.when(n % 11 == 0, F.concat(F.lit("no "), "document_id")).otherwise(F.col("document_id")).alias("document_id"),
        F.when(n % 4 == 0, "FAILED").when(n % 4 == 1, "RECEIVED").otherwise("OCR_DONE").alias("target"), F.lit("asked").alias("error_detail"), F.when(n % 5 == 0, "RECEIVED").alias("expected"),
    )
    return store.judge(asked).select("case_id", "document_id", "stage", "attempt_count", "error_detail", "outcome")


TRANSITION_REQUESTS = f"""WITH {STATUS}, r AS (SELECT *, event_id % 11 = 0 AS gone, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RECEIVED' ELSE 'OCR_DONE' END AS t FROM s)
SELECT case_id, CASE WHEN gone THEN 'no ' || document_id ELSE document_id END AS document_id, t AS stage, CASE WHEN NOT gone THEN attempt_count + CASE WHEN stage = 'FAILED' THEN 1 ELSE 0 END END AS attempt_count,
  CASE WHEN t = 'FAILED' THEN 'asked' END AS error_detail,
  CASE WHEN gone THEN 'missing' WHEN event_id % 5 = 0 AND stage <> 'RECEIVED' THEN 'conflict'
    WHEN (stage = 'RECEIVED' AND t <> 'RECEIVED') OR (stage = 'OCR_DONE' AND t = 'FAILED') OR (stage = 'FAILED' AND t <> 'FAILED') THEN 'ok' ELSE 'invalid' END AS outcome FROM r"""


def result_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = derived.table(spark, sf_dir, "documents").select("doc_id").select(
        n, F.when(n % 13 != 0, n % 2 == 0).alias("ok"), F.lit("k").alias("case_id"), n.cast("string").alias("document_id"),
        F.when(n % 3 > 0, F.struct(F.lit("k").alias("case_id"), F.when(n % 7 == 0, "other").otherwise(n.cast("string")).alias("document_id"))).alias("result"),
        F.when(n % 5 == 0, "why").when(n % 5 == 1, " \n").alias("error_detail"),
    )
    return rows.select("doc_id", results.shape_problem(*(F.col(c) for c in ("ok", "case_id", "document_id", "result", "error_detail"))).alias("problem"))


RESULT_SHAPES = """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'no result record'
  WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 OR doc_id % 5 < 2 THEN 'success needs a result and no error' WHEN doc_id % 7 = 0 THEN 'the result is another document''s' END
  WHEN doc_id % 3 > 0 OR doc_id % 5 > 0 THEN 'failure needs an error and no result' END AS problem FROM documents"""


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    t = derived.table(spark, sf_dir, "orders").select("o_orderkey")
    value = F.when(n % 4 == 0, F.concat(F.lit("Caso Nº "), n)).when(n % 4 == 1, F.concat(F.lit(".."), n)).when(n % 4 == 2, F.concat(F.lit("a/"), n)).otherwise("..")
    t = t.withColumn("value", value)
    form = F.create_map(F.lit("n"), n.cast("string"))
    block = form_block(F.when(n % 2 == 0, form).otherwise(F.create_map().cast("map<string,string>")), F.create_map().cast("map<string,string>"))
    return t.select(
        n.alias("id"), slug(F.col("value")).alias("slug"), is_safe_name(F.col("value")).alias("safe_name"), is_safe_id(F.col("value")).alias("safe_id"),
        (nfc(F.concat(F.lit("é"), F.col("value"))) == F.concat(F.lit("é"), F.col("value"))).alias("composed"), F.regexp_extract(block, r"- (\*\*n\*\*: \d+)", 1).alias("line"),
    )


TEXT_FORMS = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Caso-N-' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN 'a-' || o_orderkey ELSE 'x' END AS slug,
  o_orderkey % 4 = 0 AS safe_name, o_orderkey % 4 < 2 AS safe_id, true AS composed, CASE WHEN o_orderkey % 2 = 0 THEN '**n**: ' || o_orderkey ELSE '' END AS line FROM orders"""


def field_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of model replies: fenced, with unknown labels and values that are no text, of no known generation, or no JSON."""
    d = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    n = F.col("id").cast("string")
    reply = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit('```json\n{"Nombre G_X": " N'), n, F.lit(' ", "Unknown": "x", "sexo G_X": 1, "grado_certificado": "g_ 2"}\n```')))
        .when(F.col("id") % 4 == 1, F.concat(F.lit('{"grado_certificado": "G9", "Nombre  g_x": "'), n, F.lit('", "NOMBRE G_X": "last"}')))
        .when(F.col("id") % 4 == 2, "no JSON").otherwise('["a"]')
    )
    got = d.select("id", replies.parse_fields(reply, F.lit("BIRTH_CERT")).alias("f"))
    return got.select("id", F.size("f").alias("fields"), F.element_at("f", F.lit("nombre")).alias("nombre"), F.element_at("f", F.lit("grado_certificado")).alias("grado"))


FIELD_REPLIES = """SELECT doc_id AS id, CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS fields, CASE doc_id % 4 WHEN 0 THEN 'N' || doc_id WHEN 1 THEN 'last' END AS nombre,
  CASE WHEN doc_id % 4 = 0 THEN 'G2' END AS grado FROM documents"""


def model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and fields by models that are expressions: they see the first 4,000 characters, and never a blank text."""
    n = F.col("doc_id")
    d = derived.table(spark, sf_dir, "documents").select("doc_id").withColumn("extracted_text", F.when(n % 5 == 0, "--- Page 1 ---\n short").otherwise(F.concat(F.repeat(F.lit("x"), (n % 2 * 4000).cast("int")), F.lit("0123456789"), n.cast("string"))))
    kind = lambda t: F.when(F.char_length(t) >= 4000, F.lit("ID_DOCUMENT")).otherwise(F.lit("BIRTH_CERT\nG3"))
    fields = lambda t, k: F.concat(F.lit('{"Nombre G_X": "'), k, F.lit('", "Apellidos": "'), F.char_length(t).cast("string"), F.lit('"}'))
    got = replies.extract_fields(replies.classify(d, kind), fields)
    return got.select("doc_id", F.col("classification.document_type").alias("kind"), F.col("classification.generation").alias("generation"), F.element_at("field_extraction.fields", F.lit("nombre")).alias("nombre"), F.element_at("field_extraction.fields", F.lit("apellidos")).alias("apellidos"))


MODEL_DOCUMENTS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'EMPTY' WHEN doc_id % 2 = 1 THEN 'ID_DOCUMENT' ELSE 'BIRTH_CERT' END AS kind, CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 'G3' END AS generation,
  CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 'BIRTH_CERT' END AS nombre, CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 1 THEN '4000' END AS apellidos FROM documents"""


def template_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of forms by template: places of both, a label, an XFA field over an AcroForm one, and the signing block."""
    n = F.col("o_orderkey")
    text = F.when(n % 3 == 0, "A N E X O  IV").when(n % 3 == 1, "anexo i").otherwise("none")
    text_of = lambda k: F.concat(F.lit(f"{k} "), n)
    pairs = {k: text_of(k) for k in ("Textfield-5", "Textfield-9", "E-mail")} | {"a": F.lit("1"), "de": F.lit("mayo"), "de-0": F.when(n % 2 == 0, "2024").otherwise(" "), "En": F.lit("Lima")}
    acroform = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    xfa = F.create_map(F.lit("Textfield-5"), F.lit("xfa"), F.lit("provincia"), F.lit("label"))
    rows = derived.table(spark, sf_dir, "orders").select(n.alias("id"), adapter.anexo_variant(text).alias("variant"), acroform.alias("a"), F.when(n % 5 == 0, xfa).alias("x"))
    got = adapter.with_form_attributes(rows, "a", "x", "variant", "f", "true")
    return got.select("id", "variant", *(F.element_at("f", F.lit(k)).alias(k) for k in ("domicilio", "provincia", "email", "nacionalidad_origen_progenitor", "lugar_presentacion", "fecha_presentacion")))


TEMPLATE_PLACES = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'ANEXO_III_IV' WHEN 1 THEN 'ANEXO_I' END AS variant,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'xfa' ELSE 'Textfield-5 ' || o_orderkey END END AS domicilio,
  CASE WHEN o_orderkey % 5 = 0 THEN 'label' WHEN o_orderkey % 3 = 1 THEN 'Textfield-5 ' || o_orderkey END AS provincia,
  'E-mail ' || o_orderkey AS email, CASE WHEN o_orderkey % 3 = 1 THEN 'Textfield-9 ' || o_orderkey END AS nacionalidad_origen_progenitor,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Lima' END AS lugar_presentacion, CASE WHEN o_orderkey % 6 = 0 THEN '1/mayo/2024' END AS fecha_presentacion FROM orders"""


def xfa_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    one = F.concat(F.lit("<x:data xmlns:x='u'><x:name> n"), n, F.lit(" </x:name><empty> </empty></x:data>"))
    xml = F.when(n % 4 == 0, one).when(n % 4 == 1, F.concat(F.lit("<template/><datasets>k"), n, F.lit("</datasets><form/>"))).when(n % 4 == 2, "<form><name>x</name></form>")
    got = derived.table(spark, sf_dir, "documents").select("doc_id", files.parse_xfa(xml.cast("binary")).alias("f"))
    return got.select("doc_id", F.size("f").alias("fields"), F.coalesce(F.element_at("f", F.lit("name")), F.element_at("f", F.lit("datasets"))).alias("value"))


XFA_FORMS = """SELECT doc_id, CAST(CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END AS INTEGER) AS fields, CASE doc_id % 4 WHEN 0 THEN 'n' || doc_id WHEN 1 THEN 'k' || doc_id END AS value FROM documents"""


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    name = F.concat(F.when(n % 5 == 0, ".").otherwise("file "), n, F.when(n % 3 == 0, ".PDF").when(n % 3 == 1, ".v2.jpeg").otherwise(".txt"))
    rows = derived.table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), name).alias("path"), (n % 3 * 26214401).alias("length"))
    return files.listed(rows).join(rows, "path").select("document_id", "path", files.file_problem(F.col("path"), F.col("length")).alias("problem"))


FILE_LISTING = """SELECT 'file ' || page_id || CASE WHEN page_id % 3 = 1 THEN '.v2' ELSE '' END AS document_id, '/in/file ' || page_id || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.v2.jpeg' END AS path,
  CASE WHEN page_id % 3 = 0 THEN 'empty file' END AS problem FROM pages WHERE page_id % 5 > 0 AND page_id % 3 < 2"""


def case_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.status(spark, sf_dir)
    got = status.case_details(rows, rows.where("cast(case_id as int) % 2 = 0").select("case_id"), running=F.col("case_id").endswith("1"))
    return got.select("case_id", "total", "case_status", "running", "interrupted", F.col("case_label.en").alias("label"), F.col("message").isNotNull().alias("told"), F.array_join(F.transform("docs", lambda d: F.concat_ws(":", d["document_id"], d["stage_label"]["en"])), ",").alias("docs"))


CASE_DETAILS = f"""WITH {STATUS}, c AS (
  SELECT case_id, count(*) AS total, count(*) FILTER (stage = 'FAILED') > 0 AS bad, bool_and(stage = 'OCR_DONE') AS done, bool_or(stage = 'RECEIVED') AS received, case_id LIKE '%1' AS running, CAST(case_id AS INTEGER) % 2 = 0 AS judged,
    string_agg(document_id || ':' || CASE stage WHEN 'FAILED' THEN 'Failed' WHEN 'OCR_DONE' THEN 'Read complete' ELSE CASE WHEN case_id LIKE '%1' THEN 'Processing' ELSE 'Interrupted' END END, ',' ORDER BY document_id) AS docs FROM s GROUP BY case_id),
t AS (SELECT *, CASE WHEN bad THEN 'FAILED' WHEN done THEN CASE WHEN judged THEN 'RULES_EVALUATED' ELSE 'OCR_DONE' END ELSE 'RECEIVED' END AS case_status, NOT running AND received AS interrupted FROM c)
SELECT case_id, total, case_status, running, interrupted, CASE case_status WHEN 'FAILED' THEN 'Has errors' WHEN 'OCR_DONE' THEN 'Ready for evaluation' WHEN 'RULES_EVALUATED' THEN 'Evaluated' ELSE CASE WHEN interrupted THEN 'Interrupted' ELSE 'Processing' END END AS label,
  interrupted AS told, docs FROM t"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.status(spark, sf_dir)
    asked = rows.where("cast(document_id as long) % 3 <> 0").select("case_id", "document_id", (-F.col("document_id").cast("long")).alias("position"))
    return status.run_summary(status.fail_unfinished(rows, "stopped", F.lit("2025-06-01T00:00:00Z")), asked).join(status.any_launchable(rows), "case_id")


RUN_SUMMARY = f"""WITH {STATUS}, f AS (
  SELECT *, CASE WHEN stage = 'RECEIVED' THEN 'FAILED' ELSE stage END AS now, bool_or(stage = 'RECEIVED' OR (stage = 'FAILED' AND attempt_count < 3)) OVER (PARTITION BY case_id) AS any_launchable FROM s)
SELECT case_id, document_id, -event_id AS position, now AS stage, attempt_count, CASE WHEN stage = 'RECEIVED' THEN '2025-06-01T00:00:00Z' ELSE last_updated END AS last_updated,
  CASE WHEN stage = 'RECEIVED' THEN 'stopped' ELSE error_detail END AS error_detail, count(*) OVER w AS total, count(*) FILTER (now = 'OCR_DONE') OVER w AS succeeded, count(*) FILTER (now = 'FAILED') OVER w AS failed, any_launchable
FROM f WHERE event_id % 3 <> 0 WINDOW w AS (PARTITION BY case_id)"""


def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many attributes each document has filled in, and which document is its case's first application."""
    docs = adapter.canonical_documents(derived.case_extractions(spark, sf_dir))
    first = adapter.first_application(docs.select("case_id", "document_id", "document_type")).select("case_id", F.col("document_id").alias("first"))
    return adapter.populated_fields(docs).select("case_id", "document_id", F.size("fields").alias("filled")).join(first, "case_id", "left")


FILLED_FIELDS = f"""WITH {_CASES}
SELECT case_id, document_id, CAST(CASE document_type WHEN 'APPLICATION' THEN CASE WHEN v = 3 THEN 19 ELSE 20 END WHEN 'ID_DOCUMENT' THEN 9 WHEN 'BIRTH_CERT' THEN 13 - CASE WHEN v IN (0, 6, 9) AND (k - 2) % 3 = 1 THEN 6 ELSE 0 END ELSE 0 END AS INTEGER) AS filled,
  'a' AS first FROM d"""

def applicant_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who the identity documents of a case are of: the number of persons, and the one's attributes and flags."""
    got = lineage.resolve_lineage(derived.identity_documents(spark, sf_dir)).selectExpr("case_id", "g1.*")
    return got.selectExpr("case_id", "persons", "ambiguous", "array_join(array_sort(flags), '|') as flags", "size(documents) as documents", "person.name as name", "person.born as born", "person.number as number", "person.nation as nation")


# Pairs and what is reached by them, from the records themselves.
APPLICANT_ROLES = """WITH RECURSIVE o AS (
  SELECT o_custkey AS c, o_orderkey AS k, (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS g, o_orderkey // 4 % 3 + 1 AS f,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS born, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders),
s AS (SELECT *, ['Ana', 'José', 'Lucía', 'Iñés'][g] AS given, ['García', 'Núñez', 'Pérez'][f] AS father, ['ana', 'jose', 'lucia', 'ines'][g] AS fg, ['garcia', 'nunez', 'perez'][f] AS ff FROM o),
n AS (
  SELECT c, k, born, CASE k % 5 WHEN 0 THEN given WHEN 1 THEN father WHEN 4 THEN '' ELSE given || ' ' || father END AS name,
    CASE k % 5 WHEN 0 THEN [fg] WHEN 1 THEN [ff] WHEN 4 THEN CAST([] AS VARCHAR[]) ELSE [fg, ff] END AS words, CASE WHEN t % 3 = 0 THEN '' ELSE 'n-' || (t % 7 % 2) END AS number, ['ESP', 'Española', '', ''][k % 4 + 1] AS nation FROM s),
r AS MATERIALIZED (SELECT * FROM n WHERE name <> '' OR born IS NOT NULL OR number <> '' OR nation <> ''),
p AS (
  SELECT a.c, a.k AS x, b.k AS y, a.name <> '' AND b.name <> '' AS named, len(a.words) > 0 AND len(b.words) > 0 AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words)) AS fuzzy,
    coalesce(year(greatest(a.born, b.born)) - year(least(a.born, b.born)) - CASE WHEN strftime(greatest(a.born, b.born), '%m%d') < strftime(least(a.born, b.born), '%m%d') THEN 1 ELSE 0 END <= 1 AND a.born IS NOT NULL AND b.born IS NOT NULL, false) AS near,
    a.number <> '' AND a.number = b.number AS same, a.born IS NULL OR b.born IS NULL AS undated FROM r a JOIN r b ON a.c = b.c AND a.k <> b.k),
e AS MATERIALIZED (SELECT *, CAST(fuzzy AS INTEGER) + CAST(near AS INTEGER) + CAST(same AS INTEGER) >= 2 AS strict FROM p),
u(c, x, y) AS (SELECT c, k, k FROM r UNION SELECT u.c, u.x, e.y FROM u JOIN e ON e.c = u.c AND e.x = u.y AND (e.strict OR (e.fuzzy AND e.undated))),
v(c, x, y) AS (SELECT c, k, k FROM r UNION SELECT v.c, v.x, e.y FROM v JOIN e ON e.c = v.c AND e.x = v.y AND e.strict),
q AS (SELECT c, CAST(count(DISTINCT m) AS INTEGER) AS persons FROM (SELECT c, x, min(y) AS m FROM u GROUP BY c, x) GROUP BY c),
w AS (SELECT c, count(DISTINCT m) AS persons FROM (SELECT c, x, min(y) AS m FROM v GROUP BY c, x) GROUP BY c),
d AS (SELECT c, bool_or(named AND NOT fuzzy) AS unlike FROM e GROUP BY c),
a AS (
  SELECT c, CAST(count(*) AS INTEGER) AS n, arg_min(name, k) FILTER (name <> '') AS name, arg_min(born, k) FILTER (born IS NOT NULL) AS born, arg_min(number, k) FILTER (number <> '') AS number, arg_min(nation, k) FILTER (nation <> '') AS nation,
    count(DISTINCT born) > 1 AS births, count(DISTINCT number) FILTER (number <> '') > 1 AS numbers FROM r GROUP BY c)
SELECT CAST(z.c AS VARCHAR) AS case_id, coalesce(persons, 0) AS persons, coalesce(persons, 0) > 1 AS ambiguous,
  CASE WHEN persons > 1 THEN 'NOMBRE_AMBIGUO' WHEN persons = 1 THEN concat_ws('|', CASE WHEN births THEN 'FECHA_CONFLICTO' END, CASE WHEN weak > 1 THEN 'GENERACION_INFERIDA_BAJA_CONFIANZA' END, CASE WHEN numbers THEN 'ID_INCONSISTENTE' END, CASE WHEN unlike THEN 'NOMBRE_INCONSISTENTE' END) ELSE '' END AS flags,
  CASE WHEN persons = 1 THEN n ELSE 0 END AS documents, CASE WHEN persons = 1 THEN name END AS name, CASE WHEN persons = 1 THEN born END AS born, CASE WHEN persons = 1 THEN number END AS number, CASE WHEN persons = 1 THEN nation END AS nation
FROM (SELECT DISTINCT c FROM n) z LEFT JOIN (SELECT q.*, w.persons AS weak FROM q JOIN w USING (c)) USING (c) LEFT JOIN d USING (c) LEFT JOIN a USING (c)"""

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "extraction_latest": (extraction_latest, EXTRACTION_LATEST),
    "case_verdict_full": (case_verdict_full, CASE_VERDICT_FULL),
    "transition_requests": (transition_requests, TRANSITION_REQUESTS),
    "result_shapes": (result_shapes, RESULT_SHAPES),
    "text_forms": (text_forms, TEXT_FORMS),
    "field_replies": (field_replies, FIELD_REPLIES),
    "model_documents": (model_documents, MODEL_DOCUMENTS),
    "template_places": (template_places, TEMPLATE_PLACES),
    "xfa_forms": (xfa_forms, XFA_FORMS),
    "file_listing": (file_listing, FILE_LISTING),
    "case_details": (case_details, CASE_DETAILS),
    "run_summary": (run_summary, RUN_SUMMARY),
    "filled_fields": (filled_fields, FILLED_FIELDS),
    "applicant_roles": (applicant_roles, APPLICANT_ROLES),
}

"""Registered queries over whole derived tables, each with SQL that tells the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.config import Rules
from casegraph.functions.dates import generation_gap, with_dates, within_years, years_between
from casegraph.functions.text import clean_text, doc_numbers_match, fold_doc_number, fold_name, fold_nationality, fuzzy_folded, strip_page_headers
from casegraph.operators import adapter, decision, replies, report, status
from casegraph.plans import records
from casegraph.sources import derived

STAGE = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RECEIVED' ELSE 'OCR_DONE' END"
STATUS = f"""s AS (
  SELECT CAST(event_id // 5 AS VARCHAR) AS case_id, CAST(event_id AS VARCHAR) AS document_id, {STAGE} AS stage,
    CAST(event_id % 3 + 1 AS INTEGER) AS attempt_count, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
    CASE WHEN event_type = 'error' THEN 'error ' || (event_id % 7) END AS error_detail FROM events)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = derived.case_extractions(spark, sf_dir)
    docs = adapter.canonical_documents(rows)
    return rows, docs, report.snapshots(decision.verdicts(docs))


def case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.case_colour(status.case_table(derived.status(spark, sf_dir))).drop("evaluated")


CASE_LIST = f"""WITH {STATUS}
SELECT case_id, count(*) AS total, count(*) FILTER (stage = 'OCR_DONE') AS ocr_done, count(*) FILTER (stage = 'FAILED') AS failed,
  count(*) FILTER (stage = 'RECEIVED') AS received, max(last_updated) AS last_updated,
  CASE WHEN bool_or(stage = 'FAILED') THEN 'FAILED' WHEN bool_and(stage = 'OCR_DONE') THEN 'OCR_DONE' ELSE 'RECEIVED' END AS case_status,
  CASE WHEN bool_or(stage = 'FAILED') THEN 'red' WHEN bool_and(stage = 'OCR_DONE') THEN 'green' ELSE 'amber' END AS colour
FROM s GROUP BY case_id"""


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict request answers for each case of the events: here none has a snapshot."""
    rows = derived.status(spark, sf_dir)
    none = spark.createDataFrame([], "case_id string, estado string, justificacion string")
    out = report.case_verdicts(rows, none)
    return out.select("case_id", "result", "case_status", F.array_join(F.transform("failed", lambda f: F.concat_ws(":", f["name"], f["tries"], f["error_detail"])), ",").alias("failed"), F.array_join("pending", ",").alias("pending"))


CASE_RESULTS = f"""WITH {STATUS}, c AS (
  SELECT case_id, bool_or(stage = 'FAILED') AS bad, bool_and(stage = 'OCR_DONE') AS done,
    string_agg(document_id || ':' || attempt_count || ':' || error_detail, ',' ORDER BY document_id) FILTER (stage = 'FAILED') AS f,
    string_agg(document_id, ',' ORDER BY document_id) FILTER (stage <> 'OCR_DONE') AS p
  FROM s GROUP BY case_id)
SELECT case_id, CASE WHEN bad THEN 'failed' WHEN done THEN 'verdict' ELSE 'pending' END AS result,
  CASE WHEN bad THEN 'FAILED' WHEN done THEN 'OCR_DONE' ELSE 'RECEIVED' END AS case_status,
  CASE WHEN bad THEN f END AS failed, CASE WHEN NOT bad AND NOT done THEN p END AS pending FROM c"""


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = status.document_rows(derived.status(spark, sf_dir))
    return rows.select("case_id", "document_id", "stage", F.col("stage_label.es").alias("es"), F.col("stage_label.en").alias("en"), status.is_launchable(F.col("stage"), F.col("attempt_count"), 3).alias("launchable"))


DOCUMENT_LABELS = f"""WITH {STATUS}
SELECT case_id, document_id, stage,
  CASE stage WHEN 'FAILED' THEN 'Error' WHEN 'OCR_DONE' THEN 'Lectura completada' ELSE 'Interrumpido' END AS es,
  CASE stage WHEN 'FAILED' THEN 'Failed' WHEN 'OCR_DONE' THEN 'Read complete' ELSE 'Interrupted' END AS en,
  stage = 'RECEIVED' OR (stage = 'FAILED' AND attempt_count < 3) AS launchable FROM s"""


def missing_extraction_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.status(spark, sf_dir)
    return adapter.missing_extractions(rows, rows.where(F.col("document_id").cast("long") % 7 != 0))


MISSING_EXTRACTION = f"WITH {STATUS} SELECT case_id, document_id, stage FROM s WHERE CAST(document_id AS BIGINT) % 7 = 0"


def transition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.audit_transitions(derived.transitions(spark, sf_dir)).select("document_id", "seq", "target", "previous", "valid")


_VALID = "(({a} = 'RECEIVED' AND {b} <> 'RECEIVED') OR ({a} = 'OCR_DONE' AND {b} = 'FAILED') OR ({a} = 'FAILED' AND {b} <> 'FAILED'))"
TRANSITION_AUDIT = f"""WITH t AS (
  SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS seq, {STAGE} AS target FROM events),
p AS (SELECT *, lag(target) OVER (PARTITION BY document_id ORDER BY seq) AS previous FROM t)
SELECT *, previous IS NULL OR {_VALID.format(a="previous", b="target")} AS valid FROM p"""


def transition_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.fold_events(derived.transitions(spark, sf_dir)).drop("case_id")


TRANSITION_FOLD = f"""WITH t AS (
  SELECT CAST(user_id AS VARCHAR) AS document_id, list({{'stage': {STAGE}, 'n': 0, 'moment': strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'err': 'error ' || (event_id % 7), 'bad': 0}} ORDER BY event_id) AS l
  FROM events GROUP BY user_id),
f AS (
  SELECT document_id, list_reduce(
    list_concat([{{'stage': 'RECEIVED', 'n': 1, 'moment': l[1].moment, 'err': CAST(NULL AS VARCHAR), 'bad': 0}}], CASE WHEN l[1].stage = 'RECEIVED' THEN l[2:] ELSE l END),
    lambda a, x: CASE WHEN {_VALID.format(a="a.stage", b="x.stage")}
      THEN {{'stage': x.stage, 'n': a.n + CASE WHEN a.stage = 'FAILED' THEN 1 ELSE 0 END, 'moment': x.moment, 'err': CASE WHEN x.stage = 'FAILED' THEN x.err END, 'bad': a.bad}}
      ELSE {{'stage': a.stage, 'n': a.n, 'moment': a.moment, 'err': a.err, 'bad': a.bad + 1}} END) AS r FROM t)
SELECT document_id, r.stage AS stage, CAST(r.n AS INTEGER) AS attempt_count, r.moment AS last_updated, r.err AS error_detail, CAST(r.bad AS INTEGER) AS rejected FROM f"""


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.dirty_texts(spark, sf_dir).select("doc_id", strip_page_headers(clean_text(F.col("text"))).alias("text"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN_TEXTS = f"""SELECT doc_id, {_TRIM.format("text")} AS text FROM documents"""


def person_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.person_pairs(spark, sf_dir).withColumns({"a": fold_name("a_name"), "b": fold_name("b_name")})
    p = p.withColumns({
        "number": fold_doc_number("b_number"), "nation": fold_nationality("a_nation"), "same_name": F.col("a") == F.col("b"), "fuzzy": fuzzy_folded(F.col("a"), F.col("b")),
        "same_number": doc_numbers_match(F.col("a_number"), F.col("b_number")), "near": within_years(F.col("a_born"), F.col("b_born"), 1),
        "years": years_between(F.least("a_born", "b_born"), F.greatest("a_born", "b_born")), "gap": generation_gap(F.col("a_born"), F.col("b_born"), 1, 3),
        "valid_to": F.add_months("a_born", 6),
    })
    p = p.withColumn("years", F.when(F.col("b_born").isNotNull(), F.col("years")))
    score = sum((F.col(c).cast("int") for c in ("fuzzy", "near")), F.col("same_number").cast("int"))
    return p.select("id", "a", "b", "number", "nation", "same_name", "fuzzy", "same_number", "near", "years", "gap", "valid_to", score.alias("score"))


PERSON_MATCHES = """WITH o AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, ['ana', 'jose', 'lucia', 'ines'][o_orderkey % 4 + 1] AS g, ['garcia', 'nunez', 'perez'][o_orderkey % 3 + 1] AS f FROM orders),
p AS (
  SELECT id, g || ' ' || f AS a, CASE id % 5 WHEN 0 THEN g || ' ' || f WHEN 1 THEN g WHEN 2 THEN f || ' ' || g WHEN 3 THEN 'luis torres' ELSE '' END AS b,
    'AB' || (id % 4) AS number, CASE id % 3 WHEN 2 THEN 'boliviana' ELSE 'espanola' END AS nation, id % 5 = 0 AS same_name, id % 5 < 3 AS fuzzy, id % 9 = id % 4 AS same_number,
    d, CASE WHEN id % 11 <> 0 THEN d + CAST(id % 1500 AS INTEGER) END AS e FROM o),
y AS (SELECT *, CAST(year(e) - year(d) - CASE WHEN month(e) * 100 + day(e) < month(d) * 100 + day(d) THEN 1 ELSE 0 END AS INTEGER) AS years FROM p),
z AS (SELECT *, coalesce(years <= 1, false) AS near, coalesce(years NOT BETWEEN 1 AND 3, false) AS gap FROM y)
SELECT id, a, b, number, nation, same_name, fuzzy, same_number, near, years, gap, CAST(d + INTERVAL 6 MONTH AS DATE) AS valid_to,
  CAST(fuzzy AS INTEGER) + CAST(near AS INTEGER) + CAST(same_number AS INTEGER) AS score FROM z"""


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dates(derived.written_dates(spark, sf_dir).select("id", "written"), parsed="written").drop("written")


PARSE_DATES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 6 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders"


def classify_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.replies(spark, sf_dir).withColumn("t", replies.parse_classification(F.col("reply")))
    return r.select("id", "t.document_type", "t.generation")


CLASSIFY_REPLIES = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'APPLICATION' WHEN 1 THEN 'ID_DOCUMENT' WHEN 2 THEN 'BIRTH_CERT' ELSE 'OTHER' END AS document_type,
  CASE WHEN doc_id % 6 = 2 AND doc_id % 4 > 0 THEN 'G' || (doc_id % 4) END AS generation FROM documents"""


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapter.canonical_documents(derived.case_extractions(spark, sf_dir))
    return docs.select("case_id", "document_id", "document_type", "generation", F.array_join("missing_fields", ",").alias("missing"), F.col("solicitud.fecha_presentacion").alias("filed"), F.col("certificado.apostillado").alias("sealed"))


_CASES = """o AS (SELECT o_orderkey // 10 AS c, o_orderkey % 10 AS k, (o_orderkey // 10) % 10 AS v FROM orders),
d AS (
  SELECT CAST(c AS VARCHAR) AS case_id, ['a', 'b', 'c1', 'c2', 'c3', 'd1', 'd2', 'd3', 'o', 'z'][k + 1] AS document_id, k, v,
    CASE WHEN k = 0 THEN 'APPLICATION' WHEN k = 1 THEN 'ID_DOCUMENT' WHEN k = 9 THEN 'EMPTY' WHEN k = 8 OR (v = 1 AND k IN (5, 6, 7)) OR (v = 8 AND k IN (4, 7)) THEN 'OTHER' ELSE 'BIRTH_CERT' END AS document_type
  FROM o)"""
MISSING_FIELDS = f"""WITH {_CASES}
SELECT case_id, document_id, document_type, CASE WHEN document_type = 'BIRTH_CERT' AND NOT (v = 9 AND k IN (2, 5)) THEN 'G' || ((k - 2) % 3 + 1) END AS generation,
  CASE WHEN k = 0 AND v = 3 THEN 'fecha_presentacion' ELSE '' END AS missing,
  CASE WHEN k = 0 AND v <> 3 THEN '01/Octubre/2025' END AS filed, CASE WHEN document_type = 'BIRTH_CERT' THEN true END AS sealed FROM d"""


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from extraction records to verdicts, in one plan."""
    snap = _snapshots(spark, sf_dir)[2]
    return snap.select("case_id", "estado", "justificacion", F.array_join("problemas", "|").alias("problemas"), "s3_footnote")


_WEAK = "GENERACION_INFERIDA_BAJA_CONFIANZA"
_PROBLEM = f"""CASE v WHEN 1 THEN '{_WEAK}' WHEN 2 THEN 'DOCUMENTO_VENCIDO|{_WEAK}' WHEN 3 THEN 'DOCUMENT_INCOMPLETE|FECHA_PRESENTACION_FALTANTE|{_WEAK}' WHEN 4 THEN 'NOMBRE_AMBIGUO|{_WEAK}'
    WHEN 5 THEN 'FECHA_CONFLICTO|{_WEAK}' WHEN 7 THEN 'DOCUMENTO_CRUZADO|{_WEAK}' WHEN 8 THEN 'Certificado de Nacimiento Español de origen' ELSE 'Ninguno' END"""
_ESTADO = "CASE WHEN v IN (2, 4, 5, 7) THEN 'ROJO' WHEN v IN (1, 3, 8) THEN 'AMARILLO' ELSE 'VERDE' END"
VERDICT = f"""WITH c AS (SELECT DISTINCT o_orderkey // 10 AS c, (o_orderkey // 10) % 10 AS v FROM orders)
SELECT CAST(c AS VARCHAR) AS case_id, {_ESTADO} AS estado,
  CASE {_ESTADO} WHEN 'ROJO' THEN 'Se detectaron conflictos que impiden validar el caso automáticamente.'
    WHEN 'AMARILLO' THEN 'El caso requiere revisión manual: faltan documentos o hay observaciones menores.'
    ELSE 'El caso cumple todos los controles automáticos sin observaciones.' END AS justificacion,
  {_PROBLEM} AS problemas, CASE WHEN v = 4 THEN 'G1: nombre ambiguo, no se pudo resolver a una única persona.' END AS s3_footnote FROM c"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lineage_rows(_snapshots(spark, sf_dir)[2])


LINEAGE = """WITH c AS (
  SELECT CAST(o_orderkey // 10 AS VARCHAR) AS case_id, (o_orderkey // 10) % 10 AS v, ['Ana', 'José', 'Lucía', 'Iñés'][(o_orderkey // 100) % 4 + 1] AS g, ['García', 'Núñez', 'Pérez'][(o_orderkey // 100) % 3 + 1] AS f
  FROM orders WHERE o_orderkey % 10 = 0)
SELECT case_id, 'G1' AS gen, 'Solicitante' AS es, 'Applicant' AS en, CASE WHEN v <> 4 THEN g || ' ' || f END AS name, CASE WHEN v <> 4 THEN '1990-01-01' END AS birth, CASE WHEN v <> 4 THEN 'La Paz / Bolivia' END AS place FROM c
UNION ALL SELECT case_id, 'G2', 'Progenitor', 'Parent', CASE WHEN v = 6 THEN 'María Díaz' ELSE 'Pedro Ruiz' END, CASE WHEN v <> 6 THEN '1960-01-01' END, CASE WHEN v <> 6 THEN 'La Paz / Bolivia' END FROM c
UNION ALL SELECT case_id, 'G3', 'Abuelo/a', 'Grandparent', 'Carlos Ruiz', CASE WHEN v <> 8 THEN '1930-01-01' END, CASE WHEN v <> 8 THEN 'La Paz / Bolivia' END FROM c"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issues(_snapshots(spark, sf_dir)[2], Rules()).withColumn("docs", F.array_join("docs", ","))


ISSUES = f"""WITH c AS (SELECT DISTINCT o_orderkey // 10 AS c, (o_orderkey // 10) % 10 AS v FROM orders),
p AS (SELECT c, v, unnest(string_split({_PROBLEM}, '|')) AS p, generate_subscripts(string_split({_PROBLEM}, '|'), 1) - 1 AS i FROM c)
SELECT CAST(c AS VARCHAR) AS case_id, CAST(i AS INTEGER) AS position, CASE WHEN v = 8 THEN 'FALTANTE: ' || p ELSE p END AS code, CASE WHEN v = 8 OR p IN ('DOCUMENT_INCOMPLETE', 'FECHA_PRESENTACION_FALTANTE', 'GENERACION_INFERIDA_BAJA_CONFIANZA') THEN 'AMARILLO' ELSE 'ROJO' END AS severity,
  CASE WHEN v = 8 THEN 'Falta: ' || p ELSE p END AS es, CASE WHEN v = 8 THEN 'Missing: Spanish-origin Birth Certificate' ELSE p END AS en,
  CASE p WHEN 'DOCUMENTO_VENCIDO' THEN 'b' WHEN 'DOCUMENT_INCOMPLETE' THEN 'a' ELSE '' END AS docs
FROM p WHERE p <> 'Ninguno'"""


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.checklist_rows(_snapshots(spark, sf_dir)[2])


CHECKLIST = """WITH c AS (SELECT DISTINCT o_orderkey // 10 AS c, (o_orderkey // 10) % 10 AS v FROM orders),
l AS (SELECT * FROM (VALUES (0, 'Solicitud Principal', 'Main Application'), (1, 'Identificación del Solicitante', 'Applicant''s ID'),
  (2, 'Certificado de Nacimiento del Solicitante', 'Applicant''s Birth Certificate'), (3, 'Certificado de Nacimiento del Progenitor', 'Parent''s Birth Certificate'),
  (4, 'Certificado de Nacimiento Español de origen', 'Spanish-origin Birth Certificate')) AS t(position, es, en))
SELECT CAST(c AS VARCHAR) AS case_id, CAST(position AS INTEGER) AS position, es, en, NOT (v = 8 AND position = 4) AS present FROM c, l"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.inventory(_snapshots(spark, sf_dir)[2])


INVENTORY = """SELECT CAST(o_orderkey // 10 AS VARCHAR) AS case_id, CAST(CASE WHEN (o_orderkey // 10) % 10 = 8 THEN 4 ELSE 5 END AS INTEGER) AS present, 5 AS total,
  CAST(CASE WHEN (o_orderkey // 10) % 10 = 8 THEN 80 ELSE 100 END AS INTEGER) AS percent FROM orders WHERE o_orderkey % 10 = 0"""


def case_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docs, snap = _snapshots(spark, sf_dir)
    return report.case_meta(report.document_report(derived.case_status_rows(rows), rows, docs, snap))


CASE_META = f"""WITH {_CASES}
SELECT case_id, 'stub' AS model, round(sum(k / 4), 1) AS total_seconds, count(*) AS documents, count(*) AS done,
  count(*) FILTER (NOT (k = 0 AND v = 3) AND NOT (k = 1 AND v = 2)) AS ok, count(*) FILTER (document_type IN ('ID_DOCUMENT', 'BIRTH_CERT')) AS with_fields FROM d GROUP BY case_id"""

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "case_list": (case_list, CASE_LIST),
    "case_results": (case_results, CASE_RESULTS),
    "document_labels": (document_labels, DOCUMENT_LABELS),
    "missing_extraction_guard": (missing_extraction_guard, MISSING_EXTRACTION),
    "transition_audit": (transition_audit, TRANSITION_AUDIT),
    "transition_fold": (transition_fold, TRANSITION_FOLD),
    "clean_texts": (clean_texts, CLEAN_TEXTS),
    "person_matches": (person_matches, PERSON_MATCHES),
    "parse_dates": (parse_dates, PARSE_DATES),
    "classify_replies": (classify_replies, CLASSIFY_REPLIES),
    "missing_fields": (missing_fields, MISSING_FIELDS),
    "verdict": (verdict, VERDICT),
    "lineage": (lineage, LINEAGE),
    "issues": (issues, ISSUES),
    "checklist": (checklist, CHECKLIST),
    "inventory": (inventory, INVENTORY),
    "case_meta": (case_meta, CASE_META),
    **records.ALL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

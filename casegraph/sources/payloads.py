"""Nested records as JSON payloads, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.dates import utc_stamp
from casegraph.schemas import OCR_RESULT

SNAPSHOT = (
    "case_id string, estado string, justificacion string, problemas array<string>, "
    "s1_rows array<struct<tipo: string, descripcion: string, estado: string>>, "
    "s2_rows array<struct<documento: string, evaluacion_credencial: string, campos_faltantes: array<string>, consistencia: string, conflictos: array<string>>>, "
    "s3_rows array<struct<generacion: string, nombre_completo: string, fecha_lugar_nacimiento: string, relacion: string>>, s3_footnote string"
)
EXTRACTION_COLUMNS = ("case_id", "document_id", "source_file", "extraction", "classification", "field_extraction", "processing_seconds", "model_name", "extracted_at")
SNAPSHOT_COLUMNS = ("case_id", "estado", "justificacion", "problemas", "s1_rows", "s2_rows", "s3_rows", "s3_footnote")


def to_payload(columns: tuple[str, ...]) -> Column:
    """JSON of columns, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_payload(payload: Column, ddl: str) -> Column:
    """Struct of a JSON payload; text that is no such record is an error, as a stored record is never half read."""
    return F.from_json(payload, ddl, {"mode": "FAILFAST"})


def envelope(docs: DataFrame, moment: Column | None = None, path: str = "path") -> DataFrame:
    """Extraction records of documents: source_file is the last part of `path`, extracted_at the moment in UTC.

    `docs` has case_id, document_id, `path`, extraction, processing_seconds, model_name, and may have classification and
    field_extraction.
    """
    moment = F.current_timestamp() if moment is None else moment
    kinds = {"classification": "struct<document_type: string, generation: string, confidence: double, raw_response: string>", "field_extraction": "struct<fields: map<string,string>, raw_response: string>"}
    for name, kind in kinds.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    named = docs.withColumn("source_file", F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)).withColumn("extracted_at", utc_stamp(moment))
    return named.select(*EXTRACTION_COLUMNS)


def extraction_rows(results: DataFrame) -> DataFrame:
    """Rows of the extraction table from extraction records."""
    return results.select("case_id", "document_id", "extracted_at", "processing_seconds", to_payload(EXTRACTION_COLUMNS).alias("payload"))


def extraction_records(rows: DataFrame) -> DataFrame:
    """Extraction records from rows of the extraction table."""
    return rows.select(from_payload(F.col("payload"), OCR_RESULT).alias("r")).select("r.*")


def snapshot_rows(snapshots: DataFrame, moment: Column) -> DataFrame:
    """Rows of the evaluation table from snapshots."""
    return snapshots.select("case_id", moment.alias("evaluated_at"), to_payload(SNAPSHOT_COLUMNS).alias("payload"))


def snapshot_records(rows: DataFrame) -> DataFrame:
    """Snapshots from rows of the evaluation table."""
    return rows.select(from_payload(F.col("payload"), SNAPSHOT).alias("r")).select("r.*")

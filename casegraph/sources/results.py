"""Result files of document jobs: one JSON record a document, `<spool>/<case_id>/<document_id>.json`."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.text import is_safe_id
from casegraph.schemas import RESULT_FILE
from casegraph.sources.payloads import EXTRACTION_COLUMNS
from casegraph.sources.shared import replace_file

_RAW = f"{RESULT_FILE}, _corrupt string"


def result_path(spool: str, case_id: Column, document_id: Column) -> Column:
    """Path of a document's result file; null for ids that could leave the folder."""
    return F.when(is_safe_id(case_id) & is_safe_id(document_id), F.concat_ws("/", F.lit(spool.rstrip("/")), case_id, F.concat(document_id, F.lit(".json"))))


def shape_problem(ok: Column, case_id: Column, document_id: Column, result: Column, error_detail: Column) -> Column:
    """What is wrong with a result record, null if nothing is: success has a result of the same ids and no error, failure
    an error that isn't blank and no result."""
    same = (result["case_id"] == case_id) & (result["document_id"] == document_id)
    blank = F.regexp_replace(F.coalesce(error_detail, F.lit("")), r"(?U)\s+", "") == ""
    return (
        F.when(ok.isNull() | case_id.isNull() | document_id.isNull(), "no result record")
        .when(ok & (result.isNull() | error_detail.isNotNull()), "success needs a result and no error")
        .when(ok & ~F.coalesce(same, F.lit(False)), "the result is another document's")
        .when(~ok & (result.isNotNull() | blank), "failure needs an error and no result")
    )


def _judged(files: DataFrame) -> DataFrame:
    """Result records with `problem` and the ids that their place tells, path_case and path_document."""
    path = F.col("_metadata.file_path")
    parts = F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/")
    rows = files.withColumn("path", path).withColumn("path_case", F.element_at(parts, -2)).withColumn("path_document", F.regexp_replace(F.element_at(parts, -1), r"\.json$", ""))
    columns = (F.col(c) for c in ("ok", "case_id", "document_id", "result", "error_detail"))
    elsewhere = (F.col("case_id") != F.col("path_case")) | (F.col("document_id") != F.col("path_document"))
    problem = F.when(F.col("_corrupt").isNotNull(), "no valid JSON").otherwise(F.coalesce(shape_problem(*columns), F.when(elsewhere, "the file is another document's")))
    return rows.withColumn("problem", problem).drop("_corrupt")


def read_results(spark: SparkSession, spool: str) -> DataFrame:
    """Result records below `spool` with `problem`: null for good ones, else why the file isn't one. An absent file has no row."""
    reader = spark.read.schema(_RAW).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.json")
    return _judged(reader.json(spool))


def stream_results(spark: SparkSession, spool: str, files_a_batch: int = 10_000) -> DataFrame:
    """read_results as a stream: each file once, when it appears."""
    reader = spark.readStream.schema(_RAW).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.json")
    return _judged(reader.option("maxFilesPerTrigger", files_a_batch).json(spool))


def successes(results: DataFrame) -> DataFrame:
    """Result records of extraction records."""
    return results.select("case_id", "document_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error_detail"), F.struct(*EXTRACTION_COLUMNS).alias("result"))


def failures(failed: DataFrame) -> DataFrame:
    """Result records of failed documents (case_id, document_id, error_detail); a blank detail is an error."""
    kind = RESULT_FILE[RESULT_FILE.index("struct<") :]
    blank = F.regexp_replace(F.coalesce("error_detail", F.lit("")), r"(?U)\s+", "") == ""
    detail = F.when(blank, F.raise_error(F.lit("a failure needs an error detail"))).otherwise(F.col("error_detail"))
    return failed.select("case_id", "document_id", F.lit(False).alias("ok"), detail.alias("error_detail"), F.lit(None).cast(kind).alias("result"))


def write_results(records: DataFrame, spool: str) -> DataFrame:
    """Write each result record as its file, replaced as a whole, and return case_id, document_id, path when run.

    The spool is a folder that all executors see as files. Unsafe ids are an error.
    """
    path = result_path(spool, F.col("case_id"), F.col("document_id"))
    checked = F.when(path.isNull(), F.raise_error(F.concat(F.lit("unsafe ids for a result file: "), F.to_json(F.struct("case_id", "document_id"))))).otherwise(path)
    text = F.to_json(F.struct("ok", "case_id", "document_id", "result", "error_detail"), {"ignoreNullFields": "false"})

    def run(batches):
        for batch in batches:
            for where, what in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                json.loads(what)
                replace_file(where, what)
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["case_id", "document_id", "path"])

    return records.select("case_id", "document_id", checked.alias("path"), text.alias("_text")).mapInArrow(run, "case_id string, document_id string, path string")

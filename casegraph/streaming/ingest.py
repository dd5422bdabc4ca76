"""Result files taken into the tables, as a batch or as they appear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casegraph.sources.results import stream_results
from casegraph.sources.shared import stash
from casegraph.sources.store import Conflict, Store

# Fixed value: what is told of a document that nothing was heard of.
CRASHED = "invocation exited without recording a terminal status"
#: How often a batch is judged again where another writer came between.
TRIES = 20


def ingest(store: Store, results: DataFrame) -> DataFrame:
    """Record result files (see results.read_results): extraction and OCR_DONE, or FAILED with the file's error.

    Returns case_id, document_id, outcome: the new stage; `missing` or `invalid` where no such document is RECEIVED,
    `conflict` for a second file of a document, of which neither counts; or why the file isn't one. Only the first kind
    changes the tables. Extractions are kept before the stages, so no document is done without one. Stages are appended as
    of the batch that they were judged by; where another writer came between, all is judged again.
    """
    keys = ["case_id", "document_id"]
    ids = {"case_id": F.coalesce("path_case", "case_id"), "document_id": F.coalesce("path_document", "document_id")} if "path_case" in results.columns else {}
    files = results.withColumns(ids)
    good = files.where(F.col("problem").isNull())
    target = F.when(F.col("ok"), "OCR_DONE").otherwise("FAILED")
    requests = good.select(*keys, target.alias("target"), "error_detail", F.lit("RECEIVED").alias("expected"))
    several = good.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit(True).alias("several"))

    def judge(after: int) -> DataFrame:
        judged = store.judge(requests, after).join(several, keys, "left")
        late = (F.col("outcome") == "conflict") & (F.col("current") != "RECEIVED")
        judged = judged.withColumn("outcome", F.when(F.col("several"), "conflict").when(late, "invalid").otherwise(F.col("outcome")))
        return stash(judged.dropDuplicates(keys), "ingested")

    def keep(judged: DataFrame, after: int) -> None:
        accepted = judged.where(F.col("outcome") == "ok")
        store.put_extractions(good.where("ok").select("case_id", "document_id", "result").join(accepted.select(*keys), keys, "left_semi").select("result.*"))
        store.append("status", accepted, after)

    judged = _settled(store, judge, keep)
    told = judged.select(*keys, F.when(F.col("outcome") == "ok", F.col("stage")).otherwise(F.col("outcome")).alias("outcome"))
    return told.unionByName(files.where(F.col("problem").isNotNull()).select(*keys, F.col("problem").alias("outcome")))


def _settled(store: Store, judge: Callable[[int], DataFrame], keep: Callable[[DataFrame, int], None]) -> DataFrame:
    """What `judge` says as of a batch after which `keep` could append it."""
    for k in range(TRIES):
        after = store.last_batch("status")
        judged = judge(after)
        try:
            keep(judged, after)
            return judged
        except Conflict:
            if k == TRIES - 1:
                raise
    raise AssertionError


def reconcile(store: Store, finished: DataFrame) -> None:
    """Documents of finished jobs (case_id, document_id, perhaps reason) that are RECEIVED still become FAILED."""
    keys = ["case_id", "document_id"]
    jobs = finished if "reason" in finished.columns else finished.withColumn("reason", F.lit(None).cast("string"))
    detail = F.concat_ws(": ", F.lit(CRASHED), F.col("reason"))
    wanted = jobs.groupBy(*keys).agg(F.min("reason").alias("reason"))
    requests = wanted.select(*keys, F.lit("FAILED").alias("target"), detail.alias("error_detail"), F.lit("RECEIVED").alias("expected"))
    # those that are done or failed meanwhile stay as they are
    judge = lambda after: stash(store.judge(requests, after).where(F.col("outcome") == "ok"), "reconciled")
    _settled(store, judge, lambda judged, after: store.append("status", judged, after))


def ingest_stream(store: Store, spool: str, checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Ingest result files as they appear; `once` takes what is there and ends.

    A batch that is given again after a failure finds its documents done and changes nothing.
    """
    writer = stream_results(store.spark, spool).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.foreachBatch(lambda batch, _: ingest(store, stash(batch, "results"))).start()

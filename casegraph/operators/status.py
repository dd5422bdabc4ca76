"""Document stages: the state machine, case status, counts and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stages a document may go to from each stage.
TRANSITIONS = {"RECEIVED": ("OCR_DONE", "FAILED"), "OCR_DONE": ("FAILED",), "FAILED": ("RECEIVED", "OCR_DONE")}


def is_valid_transition(current: Column, target: Column) -> Column:
    """Whether a stage may follow another; never itself, false for unknown stages."""
    out = F.lit(False)
    for stage, targets in TRANSITIONS.items():
        out = out | ((current == stage) & target.isin(*targets))
    return F.coalesce(out, F.lit(False))


def allowed_targets(current: Column) -> Column:
    """Sorted array of the stages that may follow; empty for an unknown stage."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for stage, targets in TRANSITIONS.items():
        out = out.when(current == stage, F.array(*map(F.lit, sorted(targets))))
    return out.otherwise(F.array().cast("array<string>"))


def case_status(failed: Column, done: Column, total: Column, evaluated: Column) -> Column:
    """Status of a case from its counts: any failure rules; all done is done, or evaluated; else received."""
    whole = F.when(evaluated, "RULES_EVALUATED").otherwise("OCR_DONE")
    return F.when(total > 0, F.when(failed > 0, "FAILED").when(done == total, whole).otherwise("RECEIVED"))


def case_table(status: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """One row a case: total, ocr_done, failed, received, last_updated, case_status. One aggregation, partial first."""
    counts = status.groupBy("case_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("stage") == "OCR_DONE").alias("ocr_done"),
        F.count_if(F.col("stage") == "FAILED").alias("failed"),
        F.count_if(F.col("stage") == "RECEIVED").alias("received"),
        F.max("last_updated").alias("last_updated"),
    )
    if evaluations is None:
        counts = counts.withColumn("evaluated", F.lit(False))
    else:
        known = evaluations.select("case_id").distinct().withColumn("evaluated", F.lit(True))
        counts = counts.join(known, "case_id", "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))
    return counts.withColumn("case_status", case_status(F.col("failed"), F.col("ocr_done"), F.col("total"), F.col("evaluated")))


def case_list(status: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """The case table, newest first, then by id."""
    return case_table(status, evaluations).orderBy(F.desc("last_updated"), "case_id")


# Labels in both languages.
STAGE_LABELS = {"OCR_DONE": ("Lectura completada", "Read complete"), "FAILED": ("Error", "Failed")}
CASE_LABELS = {
    "OCR_DONE": ("Listo para evaluar", "Ready for evaluation"),
    "RULES_EVALUATED": ("Evaluado", "Evaluated"),
    "RENDERED": ("Informe generado", "Report rendered"),
    "FAILED": ("Con errores", "Has errors"),
}
PROCESSING, INTERRUPTED = ("En proceso", "Processing"), ("Interrumpido", "Interrupted")
INTERRUPTED_MESSAGE = (
    "La aplicación se reinició durante el proceso. Los documentos en estado Interrumpido no terminaron.",
    "The application restarted during processing. Documents marked Interrupted did not finish.",
)


def bilingual(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("es"), F.lit(pair[1]).alias("en"))


def _labelled(value: Column, table: dict[str, tuple[str, str]], first: Column) -> Column:
    out = first
    for key, pair in table.items():
        out = out.when(value == key, bilingual(pair))
    return out


def case_label(status: Column, interrupted: Column) -> Column:
    return _labelled(status, CASE_LABELS, F.when(status == "RECEIVED", F.when(interrupted, bilingual(INTERRUPTED)).otherwise(bilingual(PROCESSING))))


def stage_label(stage: Column, running: Column) -> Column:
    return _labelled(stage, STAGE_LABELS, F.when(stage == "RECEIVED", F.when(running, bilingual(PROCESSING)).otherwise(bilingual(INTERRUPTED))))


def document_rows(status: DataFrame, extractions: DataFrame | None = None, running: Column | None = None) -> DataFrame:
    """Status rows with labels; type, pages and seconds of the extraction for documents that are done."""
    running = F.lit(False) if running is None else running
    rows = status.withColumn("stage_label", stage_label(F.col("stage"), running))
    if extractions is None:
        return rows
    found = extractions.select(
        "case_id", "document_id",
        F.col("classification.document_type").alias("type"),
        F.col("extraction.pages_via_text_layer").alias("pages_text"),
        F.col("extraction.pages_via_vlm").alias("pages_vlm"),
        F.col("processing_seconds").alias("seconds"),
    )
    joined = rows.join(found, ["case_id", "document_id"], "left")
    done = F.col("stage") == "OCR_DONE"
    return joined.withColumns({c: F.when(done, F.col(c)) for c in ("type", "pages_text", "pages_vlm", "seconds")})


def case_details(status: DataFrame, evaluations: DataFrame | None = None, extractions: DataFrame | None = None, running: Column | None = None) -> DataFrame:
    """One row a case: the case table, labels, and its documents in order of document_id."""
    running = F.lit(False) if running is None else running
    cases = case_table(status, evaluations).withColumn("running", running)
    cases = cases.withColumn("interrupted", ~F.col("running") & (F.col("received") > 0))
    cases = cases.withColumn("case_label", case_label(F.col("case_status"), F.col("interrupted")))
    cases = cases.withColumn("message", F.when(F.col("interrupted"), bilingual(INTERRUPTED_MESSAGE)))
    rows = document_rows(status, extractions, running)
    docs = rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("document_id", *(c for c in rows.columns if c not in ("case_id", "document_id"))))).alias("docs"))
    return cases.join(docs, "case_id")


def is_launchable(stage: Column, attempts: Column, most: int) -> Column:
    """Received, or failed with attempts left."""
    return F.coalesce((stage == "RECEIVED") | ((stage == "FAILED") & (attempts < most)), F.lit(False))


def launchable(status: DataFrame, most: int = 3, wanted: DataFrame | None = None) -> DataFrame:
    """Status rows that may be launched; only those of `wanted` (case_id, document_id) if given."""
    rows = status if wanted is None else status.join(wanted.select("case_id", "document_id").distinct(), ["case_id", "document_id"], "left_semi")
    return rows.where(is_launchable(F.col("stage"), F.col("attempt_count"), most))


def any_launchable(status: DataFrame, most: int = 3) -> DataFrame:
    """case_id, any_launchable."""
    return status.groupBy("case_id").agg(F.bool_or(is_launchable(F.col("stage"), F.col("attempt_count"), most)).alias("any_launchable"))


#: What a stretch of events makes of each stage: the stage after it, and what it adds.
_STRETCH = "stage string, added int, moved boolean, last_updated string, error_detail string, rejected long"


def _next_stages() -> tuple[np.ndarray, np.ndarray]:
    """[stage, target] → stage after, and whether the transition is allowed; the last target stands for unknown ones."""
    names = list(TRANSITIONS)
    allowed = np.array([[t in TRANSITIONS[s] for t in (*names, None)] for s in names])
    stages, targets = np.arange(len(names))[:, None], np.arange(len(names) + 1)[None, :]
    return np.where(allowed, targets, stages), allowed


def stretches(targets: np.ndarray, starts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each stage to begin with, what the stretches that begin at `starts` make of it: the stage after, attempts added,
    rejected events, and the last event that was allowed (-1 for none).

    Transitions are functions on the stages, so those of all events are composed by doubling, all stretches at once.
    """
    after, allowed = _next_stages()
    n, first = len(targets), np.zeros(len(targets), bool)
    first[starts] = True
    ends = np.r_[starts[1:], n] - 1
    out = []
    for begin in range(len(after)):
        steps = after[:, targets].T.copy()  # [event, stage] → stage
        steps[starts] = after[begin, targets[starts]][:, None]
        width = 1
        while width < n:
            steps[width:] = np.take_along_axis(steps[width:], steps[:-width].copy(), 1)
            width *= 2
        now = steps[:, 0]  # each stretch begins with a constant, so what comes before it doesn't matter
        before = np.where(first, begin, np.r_[begin, now[:-1]])
        good = allowed[before, targets]
        failed = list(TRANSITIONS).index("FAILED")
        added, bad = np.add.reduceat(good & (before == failed), starts, dtype=np.int64), np.add.reduceat(~good, starts, dtype=np.int64)
        out.append({"stage": now[ends], "added": added, "rejected": bad, "last": np.maximum.reduceat(np.where(good, np.arange(n), -1), starts)})
    return out


def _folded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each batch of sorted events: its place, its first event, and the stretch by stage."""
    names, place = list(TRANSITIONS), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        case_id, document_id, target, error, moment = (batch.column(n) for n in ("case_id", "document_id", "target", "error_detail", "moment"))
        code = pa.compute.fill_null(pa.compute.index_in(target, pa.array(names)), len(names)).to_numpy()
        ids = [pa.compute.dictionary_encode(c, null_encoding="encode").indices.to_numpy() for c in (case_id, document_id)]
        starts = np.flatnonzero(np.r_[True, (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])])
        at = pa.array(starts)
        columns = {"case_id": case_id.take(at), "document_id": document_id.take(at), "place": pa.array(place + np.arange(len(starts))), "first_target": target.take(at), "first_moment": moment.take(at)}
        for name, told in zip(names, stretches(code, starts), strict=True):
            last = pa.array(np.where(told["last"] < 0, 0, told["last"]), mask=told["last"] < 0)
            failed = pa.array(told["stage"] == names.index("FAILED"))
            kept = pa.compute.if_else(failed, error.take(last), pa.nulls(len(starts), error.type))
            parts = {"stage": pa.array(np.array(names)[told["stage"]]), "added": pa.array(told["added"].astype(np.int32)), "moved": pa.array(told["last"] >= 0), "last_updated": moment.take(last), "error_detail": kept, "rejected": pa.array(told["rejected"])}
            columns[name] = pa.StructArray.from_arrays(list(parts.values()), list(parts))
        place += len(starts)
        yield pa.RecordBatch.from_pydict(columns)


def fold_events(events: DataFrame) -> DataFrame:
    """Status of each document after its requested transitions.

    `events` has case_id, document_id, seq, target, error_detail, moment. A document begins RECEIVED with attempt 1 at
    its first event, whose target RECEIVED registers it. A transition that isn't allowed changes nothing and counts as
    rejected; one out of FAILED begins a new attempt; the error detail stays only with FAILED.

    Events are dealt by ranges of document and order, so a long history is spread over many tasks. Each folds what it has
    of a document to what that makes of each stage, and these few rows are put together in order.
    """
    order = ("case_id", "document_id", "seq", "target", "error_detail", "moment")
    rows = events.select(*(F.col(c).cast("string").alias(c) if c != "seq" else c for c in order))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ", ".join(f"{s} struct<{_STRETCH}>" for s in TRANSITIONS)
    folded = dealt.drop("seq").mapInArrow(_folded_batches, f"case_id string, document_id string, place long, first_target string, first_moment string, {parts}")
    steps = F.sort_array(F.collect_list(F.struct("place", "first_target", "first_moment", *TRANSITIONS)))  # a row a batch
    grouped = folded.groupBy("case_id", "document_id").agg(steps.alias("steps"))
    start = "named_struct('stage', 'RECEIVED', 'attempt_count', 1, 'last_updated', steps[0].first_moment, 'error_detail', cast(null as string), 'rejected', 0L)"
    by_stage = " ".join(f"when '{s}' then p.{s}" for s in TRANSITIONS)
    moved = "named_struct('stage', q.stage, 'attempt_count', s.attempt_count + q.added, 'last_updated', q.last_updated, 'error_detail', q.error_detail, 'rejected', s.rejected + q.rejected)"
    stayed = "named_struct('stage', s.stage, 'attempt_count', s.attempt_count, 'last_updated', s.last_updated, 'error_detail', s.error_detail, 'rejected', s.rejected + q.rejected)"
    one = f"(s, p) -> element_at(transform(array(case s.stage {by_stage} end), q -> if(q.moved, {moved}, {stayed})), 1)"
    told = grouped.selectExpr("case_id", "document_id", f"aggregate(steps, {start}, {one}) as s", "coalesce(steps[0].first_target = 'RECEIVED', false) as registered")
    # what registers a document is no transition
    return told.selectExpr("case_id", "document_id", "s.stage", "s.attempt_count", "s.last_updated", "s.error_detail", "int(s.rejected - int(registered)) as rejected")


def audit_transitions(events: DataFrame) -> DataFrame:
    """Each event with the stage before it (by seq) and whether it might follow; the first has none and is valid."""
    previous = F.lag("target").over(Window.partitionBy("case_id", "document_id").orderBy("seq"))
    rows = events.withColumn("previous", previous)
    return rows.withColumn("valid", F.col("previous").isNull() | is_valid_transition(F.col("previous"), F.col("target")))


def fail_unfinished(status: DataFrame, detail: str, moment: Column) -> DataFrame:
    """Status rows with every RECEIVED document failed for `detail`."""
    open_ = F.col("stage") == "RECEIVED"
    return status.withColumns({
        "error_detail": F.when(open_, F.lit(detail)).otherwise(F.col("error_detail")),
        "last_updated": F.when(open_, moment).otherwise(F.col("last_updated")),
        "stage": F.when(open_, "FAILED").otherwise(F.col("stage")),
    })


def run_summary(status: DataFrame, requested: DataFrame) -> DataFrame:
    """Final row of each requested document (case_id, document_id, position), in the order of request, with case counts."""
    rows = requested.join(status, ["case_id", "document_id"], "left")
    w = Window.partitionBy("case_id")
    return rows.withColumns({
        "total": F.count("*").over(w),
        "succeeded": F.count_if(F.col("stage") == "OCR_DONE").over(w),
        "failed": F.count_if(F.col("stage") == "FAILED").over(w),
    }).orderBy("case_id", "position")


def case_colour(cases: DataFrame) -> DataFrame:
    """The case table with the colour of its mark: red with failures or interruption, green when all is done, else amber."""
    interrupted = F.col("interrupted") if "interrupted" in cases.columns else F.lit(False)
    return cases.withColumn("colour", F.when((F.col("failed") > 0) | interrupted, "red").when(F.col("ocr_done") == F.col("total"), "green").otherwise("amber"))

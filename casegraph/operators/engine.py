"""Evaluation of registered cases: bundle, verdict, snapshot, and what a service answers about a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.config import Rules
from casegraph.operators.adapter import case_documents
from casegraph.operators.decision import verdicts
from casegraph.operators.report import case_meta, case_verdicts, checklist_rows, document_report, issues, lineage_rows, snapshots
from casegraph.operators.status import case_table
from casegraph.sources.store import Store

def evaluate_cases(store: Store, cases: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Evaluate the cases of `cases` (case_id), keep their snapshots, and return these.

    All documents of a case are taken, and one without an extraction is an error. Nothing is kept if there is an error: the snapshots are one append.
    """
    wanted = cases.select("case_id").distinct()
    status = store.status().join(wanted, "case_id", "left_semi")
    docs = case_documents(status, store.extractions())
    store.put_snapshots(snapshots(verdicts(docs, rules)))
    return store.snapshots().join(wanted, "case_id", "left_semi")


def ready_cases(store: Store) -> DataFrame:
    """case_id of the cases whose documents are all done and that have no snapshot yet."""
    table = case_table(store.status(), store.latest("evaluations"))
    return table.where(F.col("case_status") == "OCR_DONE").select("case_id")


def _grouped(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """case_id and an array `name` of the other columns' structs, sorted by `order`, then by what is left."""
    rest = [c for c in rows.columns if c not in ("case_id", *order)]
    return rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def full_verdicts(status: DataFrame, extractions: DataFrame, snapshot: DataFrame, rules: Rules | None = None, check: bool = True) -> DataFrame:
    """One row a case as a service answers it: case_id, result, case_status, failed, pending, and for those with a
    verdict estado, justification_es, justification_en, issues, s1, lineage, docs, model, total_seconds.

    `snapshot` holds the snapshots of all cases whose documents are done. A document without an extraction in such a
    case is an error.
    """
    told = case_verdicts(status, snapshot)
    done = told.where(F.col("result") == "verdict").select("case_id")
    of_done = lambda df: df.join(done, "case_id", "left_semi")
    rows, records, snaps = of_done(status), of_done(extractions), of_done(snapshot)
    docs = case_documents(rows, records, check)
    report = document_report(rows, records, docs, snaps)
    parts = (
        _grouped(issues(snaps, rules), "issues", "position"), _grouped(checklist_rows(snaps), "s1", "position"), _grouped(lineage_rows(snaps), "lineage", "gen"),
        _grouped(report.drop("model_name", "ok"), "docs", "document_id"), case_meta(report).select("case_id", "model", "total_seconds"),
    )
    for part in parts:
        told = told.join(part, "case_id", "left")
    found = F.col("result") == "verdict"
    empty = F.array().cast(told.schema["issues"].dataType)
    return told.withColumn("issues", F.when(found, F.coalesce("issues", empty)))


"""Transitions folded in stretches against one after another; stages that may follow."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import status

ALLOWED = {"RECEIVED": {"OCR_DONE", "FAILED"}, "OCR_DONE": {"FAILED"}, "FAILED": {"RECEIVED", "OCR_DONE"}}
EVENT = "case_id string, document_id string, seq long, target string, error_detail string, moment string"


def one_by_one(events):
    out = {}
    for case, doc, _, target, error, moment in sorted(events, key=lambda e: tuple((x is not None, x) for x in e)):
        if (case, doc) not in out:
            out[case, doc] = ["RECEIVED", 1, moment, None, 0]
            if target == "RECEIVED":
                continue
        s = out[case, doc]
        if target in ALLOWED[s[0]]:
            s[:] = [target, s[1] + (s[0] == "FAILED"), moment, error if target == "FAILED" else None, s[4]]
        else:
            s[4] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_fold(spark, batch):
    rng = random.Random(4)
    targets = ["RECEIVED", "OCR_DONE", "FAILED", "FAILED", "other", None]
    sizes = [1, 1, 2, 5, 40, 3000]
    events = [(f"k{d % 4}" if d else None, f"d{d}", rng.choice((k, k, 7)), rng.choice(targets), rng.choice(("e", None)), f"t{k:05d}") for d in range(30) for k in range(rng.choice(sizes))]
    events += events[:20] + [("hot", "d", k, rng.choice(targets[:3]), f"e{k}", f"t{k:06d}") for k in range(20_000)]
    rng.shuffle(events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = status.fold_events(spark.createDataFrame(events, EVENT).repartition(5))
        rows = {(r["case_id"], r["document_id"]): tuple(r)[2:] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == one_by_one(events)


def test_fold_of_nothing(spark):
    assert status.fold_events(spark.createDataFrame([], EVENT)).collect() == []


def test_allowed_targets(spark):
    rows = spark.createDataFrame([(s,) for s in (*ALLOWED, "other", None)], "s string").select("s", status.allowed_targets(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == {s: sorted(t) for s, t in ALLOWED.items()} | {"other": [], None: []}

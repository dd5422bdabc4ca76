"""Document stages as a stream: the same as the fold of the events, and what is heard of jobs."""

import pytest
from pyspark.sql import functions as F

from casegraph.operators.status import fold_events
from casegraph.sources import derived
from casegraph.streaming import machine
from casegraph.streaming.machine import ENDED, LAUNCHED, POLL_FAILED, POLLED, REQUEST, Document, Patience


@pytest.fixture
def no_empty_batches(spark):
    """A stream with time-outs goes on without data for ever, and so would a run over what is there."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_stream_is_the_fold(spark, sf_dir, tmp_path, no_empty_batches):
    steps = derived.transitions(spark, sf_dir)
    first = steps.groupBy("document_id").agg(F.min_by("target", "seq").alias("t")).where("t <> 'RECEIVED'").select("document_id")
    # a document whose first event is no registration is registered before it
    register = steps.join(first, "document_id").groupBy("case_id", "document_id").agg(F.min("seq").alias("seq"), F.min_by("moment", "seq").alias("moment"))
    events = steps.select("case_id", "document_id", "seq", "target", "error_detail", "moment").unionByName(
        register.select("case_id", "document_id", F.lit(-1).cast("long").alias("seq"), F.lit("RECEIVED").alias("target"), F.lit(None).cast("string").alias("error_detail"), "moment")
    )
    events = events.select("case_id", "document_id", "seq", F.lit(REQUEST).alias("kind"), "target", F.lit(None).cast("string").alias("expected"), "error_detail", "moment")
    events.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "events"))
    changes = machine.document_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    changes.trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("case_id", "document_id").agg(F.max_by(F.struct("stage", "attempt_count", "last_updated", "error_detail"), "seq").alias("s"), F.count_if(F.col("outcome") != "ok").cast("int").alias("rejected"))
    got = last.select("case_id", "document_id", "s.*", "rejected")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, fold_events(steps).collect()), key=str)


def test_requests_and_conflicts():
    d = Document()
    assert d.ask("OCR_DONE", None, None, "0") == "missing" and d.stage is None
    assert d.ask("RECEIVED", None, None, "1") == "ok" and d.ask("RECEIVED", None, None, "2") == "invalid"
    assert d.ask("OCR_DONE", "FAILED", None, "3") == "conflict" and d.ask("FAILED", "RECEIVED", "why", "4") == "ok"
    assert (d.stage, d.attempt_count, d.last_updated, d.error_detail, d.rejected) == ("FAILED", 1, "4", "why", 2)
    assert d.ask("OCR_DONE", None, "gone", "5") == "ok" and (d.attempt_count, d.error_detail) == (2, None)


def test_jobs_time_out_or_bring_no_result():
    patience = Patience(run_seconds=10, grace_seconds=2, poll_errors=3)
    d = Document("RECEIVED", 1, "0")
    assert d.hear(LAUNCHED, None, patience, 1000) is None and d.deadline == 11_000
    for kind in (POLL_FAILED, POLL_FAILED, POLLED, POLL_FAILED, POLL_FAILED):
        assert d.hear(kind, "net", patience, 2000) is None
    assert d.hear(POLL_FAILED, "net", patience, 2000) == "the job could not be polled 3 times in a row: net"
    assert d.overdue(patience) == "the job still runs after 10 s"
    assert d.hear(ENDED, "SUCCEEDED", patience, 5000) is None and d.deadline == 7000
    assert d.overdue(patience) == "the job ended SUCCEEDED without a result file"
    d.ask("OCR_DONE", None, None, "9")
    assert d.waiting is None and d.deadline is None and d.hear(ENDED, None, patience, 1) is None and d.waiting is None


class _State:
    """What the state function sees of a key's state."""

    def __init__(self, now, value=None, over=False):
        self.now, self.get, self.exists, self.hasTimedOut, self.wait = now, value, value is not None, over, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_time_out_holds_over_batches():
    import pandas as pd

    run = machine.follow(Patience(10, 2, 3), lambda: "late")
    columns = [x.split(" ")[0] for x in machine.EVENTS.split(", ")]
    event = lambda seq, kind, target=None: pd.DataFrame([("k", "d", seq, kind, target, None, None, str(seq))], columns=columns)
    s = _State(0)
    out = pd.concat(run(("k", "d"), iter([event(0, REQUEST, "RECEIVED"), event(1, LAUNCHED)]), s))
    assert out["outcome"].tolist() == ["ok"] and s.wait == 10_000
    s = _State(4000, s.get)
    assert len(pd.concat(run(("k", "d"), iter([event(2, POLLED)]), s))) == 0 and s.wait == 6000
    s = _State(10_001, s.get, True)
    out = pd.concat(run(("k", "d"), iter([]), s))
    assert out[["stage", "last_updated", "error_detail", "outcome"]].values.tolist() == [["FAILED", "late", "the job still runs after 10 s", "overdue"]] and s.wait is None
    assert pytest.approx(s.get[1]) == 1

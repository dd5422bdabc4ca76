"""Tables, payloads, evaluation, result files and their ingestion."""

import itertools
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casegraph.config import Rules
from casegraph.operators.adapter import MissingExtraction
from casegraph.operators.engine import evaluate_cases, full_verdicts, ready_cases
from casegraph.sources import derived, results, store
from casegraph.sources.payloads import envelope
from casegraph.streaming.ingest import CRASHED, ingest, ingest_stream, reconcile

DOC = "case_id string, document_id string"
ASK = f"{DOC}, target string, error_detail string"


@pytest.fixture
def tables(spark, tmp_path):
    ticks = itertools.count()
    return store.Store(spark, str(tmp_path / "tables"), lambda: F.lit(f"2025-01-01T00:00:{next(ticks):02d}Z"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _record(case_id="k", document_id="d", **more):
    extraction = dict(file_type="pdf", extracted_text="x", page_count=1, pages_via_text_layer=1, pages_via_vlm=0, orientation_corrections={}, acroform_fields={}, xfa_fields={})
    return dict(
        case_id=case_id, document_id=document_id, source_file=f"{document_id}.pdf", extraction=extraction, classification=None, field_extraction=None,
        processing_seconds=1.5, model_name="m", extracted_at="2025-01-01T00:00:00Z",
    ) | more


def test_register_and_move(spark, tables):
    make = lambda *rows: spark.createDataFrame(rows, ASK)
    assert tables.version() == tables.migrate() == 3
    tables.register(spark.createDataFrame([("k", "b"), ("k", "a"), ("other", "a")], DOC))
    assert [r["document_id"] for r in tables.case_documents("k").collect()] == ["a", "b"]
    for again in ([("k", "a")], [("k", "z"), ("k", "z")]):
        with pytest.raises(store.DocumentExists):
            tables.register(spark.createDataFrame(again, DOC))
    assert tables.case_status("k") == "RECEIVED" and tables.case_status("none") is None
    tables.transition(make(("k", "a", "FAILED", "broken"), ("k", "b", "OCR_DONE", "dropped")))
    tables.transition(make(("k", "a", "RECEIVED", "dropped")))
    assert [tuple(r)[1:4] + (r["error_detail"],) for r in tables.case_documents("k").collect()] == [("a", "RECEIVED", 2, None), ("b", "OCR_DONE", 1, None)]
    for request, error in ((("k", "q", "FAILED", ""), store.DocumentMissing), (("k", "b", "RECEIVED", ""), store.InvalidTransition)):
        with pytest.raises(error):
            tables.transition(make(request))
    with pytest.raises(store.Conflict):
        tables.transition(make(("k", "a", "FAILED", "x")).withColumn("expected", F.lit("FAILED")))
    with pytest.raises(store.Conflict):
        tables.append("status", tables.status(), after=1)
    before, last = _rows(tables.status()), tables.last_batch("status")
    assert _rows(tables.latest("status", to=1)) == sorted((c, d, "RECEIVED", 1, "2025-01-01T00:00:00Z", None) for c, d in (("k", "a"), ("k", "b"), ("other", "a")))
    tables.compact("status")
    assert _rows(tables.status()) == before and tables.log("status").count() == 3 and tables.last_batch("status") == last + 1
    tables.vacuum("status")
    assert _rows(store.Store(spark, tables.root).status()) == before
    tables.transition(make(("k", "b", "FAILED", "x")))
    assert tables.document("k", "b").first()["stage"] == "FAILED" and tables.case_status("other") == "RECEIVED"


def test_two_writers(spark, tables):
    """Of two writers that judged by the same batch one gets Conflict; nothing of either is lost or written over."""
    make = lambda *rows: spark.createDataFrame(rows, ASK)
    tables.register(spark.createDataFrame([("k", d) for d in "abcd"], DOC))
    other = store.Store(spark, tables.root)
    publish, met = tables._publish, []

    def late(table, rows, number, kind):
        """The other writer comes between the first one's judgement and its append."""
        if not met:
            met.append(other.last_batch(table))
            other.transition(make(("k", "a", "OCR_DONE", None)))
        return publish(table, rows, number, kind)

    tables._publish = late
    with pytest.raises(store.Conflict):
        tables.transition(make(("k", "a", "FAILED", "lost")))
    assert tables.document("k", "a").first()["stage"] == "OCR_DONE"
    # both write the number before either publishes it
    met.clear()
    link, turns = store._linked, []

    def both(*paths):
        if not turns:
            turns.append(1)
            other.append("status", other.judge(make(("k", "b", "OCR_DONE", None))), other.last_batch("status"))
        return link(*paths)

    store._linked, tables._publish = both, publish
    try:
        with pytest.raises(store.Conflict):
            tables.transition(make(("k", "b", "FAILED", "lost")))
        turns.clear()
        number = tables.append("evaluations", spark.createDataFrame([], "case_id string, evaluated_at string, payload string"))
        assert number == 1 and tables.document("k", "b").first()["stage"] == "OCR_DONE"
    finally:
        store._linked = link
    # ingest and reconcile judge again
    tables._publish = late
    files = lambda d: results.successes(spark.createDataFrame([_record(document_id=d)], tables.extractions().schema)).withColumn("problem", F.lit(None).cast("string"))
    met.clear()
    other.transition(make(("k", "a", "FAILED", "again"), ("k", "b", "FAILED", "again")))
    other.transition(make(("k", "a", "RECEIVED", None), ("k", "b", "RECEIVED", None)))
    assert [r["outcome"] for r in ingest(tables, files("a")).collect()] == ["invalid"] and met  # the other was first
    met.clear()
    other.transition(make(("k", "a", "FAILED", "once more")))
    other.transition(make(("k", "a", "RECEIVED", None)))
    reconcile(tables, spark.createDataFrame([("k", "a"), ("k", "c")], DOC))
    stages = {r["document_id"]: (r["stage"], r["attempt_count"], r["error_detail"]) for r in tables.case_documents("k").collect()}
    assert met and stages == {"a": ("OCR_DONE", 3, None), "b": ("RECEIVED", 2, None), "c": ("FAILED", 1, CRASHED), "d": ("RECEIVED", 1, None)}


def test_payloads_come_back(spark, tables):
    kind = tables.extractions().schema
    first, second = _record(), _record(processing_seconds=2.0, extraction=_record()["extraction"] | {"acroform_fields": {"a": "é\n\"", "b": None}})
    tables.put_extractions(spark.createDataFrame([first], kind))
    tables.put_extractions(spark.createDataFrame([second], kind))
    assert [r.asDict(True) for r in tables.extractions().collect()] == [second]
    assert '"classification":null' in tables.latest("extractions").first()["payload"]
    files = spark.createDataFrame([("k", "d", "/a/b/Scan 1.pdf", 0.5, "m")], f"{DOC}, path string, processing_seconds double, model_name string")
    made = envelope(files.withColumn("extraction", F.lit(None).cast(kind["extraction"].dataType)), F.lit("2025-02-03 04:05:06.7").cast("timestamp")).first()
    assert (made["source_file"], made["extracted_at"]) == ("Scan 1.pdf", "2025-02-03T04:05:06Z")


def test_evaluation_and_answers(spark, tables, sf_dir):
    every = derived.case_extractions(spark, sf_dir).where("cast(case_id as int) < 12").cache()
    tables.register(every.select("case_id", "document_id"))
    tables.put_extractions(every)
    assert ready_cases(tables).isEmpty()
    tables.transition(every.where("case_id <> '3'").select("case_id", "document_id", F.lit("OCR_DONE").alias("target"), F.lit(None).cast("string").alias("error_detail")))
    done = every.where("case_id = '3'").select("case_id", "document_id", F.when(F.col("document_id") == "a", "FAILED").otherwise("OCR_DONE").alias("target"), F.lit(" why").alias("error_detail"))
    tables.transition(done.where("document_id <> 'b'"))
    ready = ready_cases(tables)
    assert "3" not in {r[0] for r in ready.collect()}
    snaps = {r["case_id"]: r for r in evaluate_cases(tables, ready).collect()}
    assert ready_cases(tables).isEmpty() and tables.case_status("2") == "RULES_EVALUATED"
    assert {k: s["estado"] for k, s in snaps.items() if len(k) == 1} | {} == {k: {"1": "AMARILLO", "8": "AMARILLO", "2": "ROJO", "4": "ROJO", "5": "ROJO", "7": "ROJO"}.get(k, "VERDE") for k in snaps if len(k) == 1}
    told = {r["case_id"]: r for r in full_verdicts(tables.status(), tables.extractions(), tables.snapshots(), Rules()).collect()}
    bad = told["3"]
    assert bad["result"] == "failed" and [tuple(f) for f in bad["failed"]] == [("a", 1, " why")] and bad["docs"] is None and bad["estado"] is None
    two = told["2"]
    assert (two["result"], two["case_status"], two["estado"], two["model"]) == ("verdict", "RULES_EVALUATED", "ROJO", "stub")
    assert [i["code"] for i in two["issues"]][0] == "DOCUMENTO_VENCIDO" and two["issues"][0]["docs"] == ["b"]
    assert [d["document_id"] for d in two["docs"]] == sorted(d["document_id"] for d in two["docs"]) and len(two["s1"]) == 5 and len(two["lineage"]) == 3
    assert two["total_seconds"] == pytest.approx(sum(d["seconds"] for d in two["docs"]), abs=0.06)
    assert told["0"]["issues"] == []
    with pytest.raises(MissingExtraction):
        full_verdicts(tables.status(), tables.extractions().where("document_id <> 'c1'"), tables.snapshots())


def test_result_files(spark, tables, tmp_path):
    spool, kind = str(tmp_path / "spool"), tables.extractions().schema
    ids = [("k", d) for d in ("ok", "bad", "both", "else", "text", "late", "done")]
    tables.register(spark.createDataFrame(ids, DOC))
    tables.transition(spark.createDataFrame([("k", "done", "OCR_DONE", None)], ASK))
    good = results.successes(spark.createDataFrame([_record(document_id=d) for d in ("ok", "done")], kind))
    failed = results.failures(spark.createDataFrame([("k", "bad", "no luck")], f"{DOC}, error_detail string"))
    assert [r["path"] for r in results.write_results(good.unionByName(failed), spool).collect()] == [f"{spool}/k/{d}.json" for d in ("ok", "done", "bad")]
    for d, value in (("both", {"ok": True, "case_id": "k", "document_id": "both", "result": None}), ("else", {"ok": False, "case_id": "k", "document_id": "ok", "error_detail": "x"}), ("text", None)):
        (tmp_path / "spool/k" / f"{d}.json").write_text(json.dumps(value) if value else "{not json")
    (tmp_path / "spool/k/.part-x").write_text("half")
    read = {r["path_document"]: r["problem"] for r in results.read_results(spark, spool).collect()}
    assert read == {"ok": None, "bad": None, "done": None, "both": "success needs a result and no error", "else": "the file is another document's", "text": "no valid JSON"}
    for pause in (False, True):  # a second stream finds all done
        ingest_stream(tables, spool, str(tmp_path / f"checkpoint{pause}"), once=True).awaitTermination()
        stages = {r["document_id"]: (r["stage"], r["error_detail"]) for r in tables.case_documents("k").collect()}
        assert stages == {"ok": ("OCR_DONE", None), "bad": ("FAILED", "no luck"), "done": ("OCR_DONE", None)} | {d: ("RECEIVED", None) for d in ("both", "else", "text", "late")}
    assert [r["document_id"] for r in tables.extractions().collect()] == ["ok"]
    told = {r["document_id"]: r["outcome"] for r in ingest(tables, results.read_results(spark, spool)).collect()}
    assert told["ok"] == told["done"] == told["bad"] == "invalid" and told["text"] == "no valid JSON"
    reconcile(tables, spark.createDataFrame([("k", "ok", None), ("k", "late", None), ("k", "text", "E: x")], f"{DOC}, reason string"))
    stages = {r["document_id"]: (r["stage"], r["error_detail"]) for r in tables.case_documents("k").collect()}
    assert stages["late"] == ("FAILED", CRASHED) and stages["text"] == ("FAILED", f"{CRASHED}: E: x") and stages["ok"][0] == "OCR_DONE"


def test_unsafe_ids_and_blank_errors(spark, tmp_path):
    row = lambda **x: spark.createDataFrame([Row(**x)])
    paths = spark.createDataFrame([("k", "d"), ("..", "d"), ("k", "a/b"), ("", "d"), ("k", "a\\b")], DOC).select(results.result_path("/s/", F.col("case_id"), F.col("document_id"))).collect()
    assert [r[0] for r in paths] == ["/s/k/d.json", None, None, None, None]
    with pytest.raises(Exception, match="error detail"):
        results.failures(row(case_id="k", document_id="d", error_detail=" \n")).collect()
    with pytest.raises(Exception, match="unsafe ids"):
        results.write_results(results.failures(row(case_id="..", document_id="d", error_detail="x")), str(tmp_path)).collect()


def test_parts_of_a_log_grow_with_it(spark, tmp_path, monkeypatch):
    """What a task sorts of a log is bounded: the log is dealt into more parts as its files grow; a row of each key is read."""
    monkeypatch.setattr(store, "PART_BYTES", 20_000)
    tables = store.Store(spark, str(tmp_path / "s"))
    rows = spark.range(4000).select(F.lit("k").alias("case_id"), F.col("id").cast("string").alias("document_id"), F.lit("RECEIVED").alias("stage"), F.lit(1).alias("attempt_count"), F.sha2(F.col("id").cast("string"), 512).alias("last_updated"), F.lit(None).cast("string").alias("error_detail"))
    tables.append("status", rows.limit(10))
    assert tables.latest("status").rdd.getNumPartitions() == 1
    tables.append("status", rows.withColumn("attempt_count", F.lit(2)))
    got = tables.latest("status")
    assert got.rdd.getNumPartitions() >= 10
    assert got.count() == 4000 and got.where("attempt_count <> 2").isEmpty()

"""Orchestration, service and command line over the tables, with jobs that are stand-ins."""

import io
import json
import sys
import threading
import urllib.request

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casegraph import cli, service
from casegraph.config import Settings
from casegraph.operators.orchestration import Busy, CaseRuns, Drive, local_job, process_documents, remote_job
from casegraph.sources.results import failures
from casegraph.sources.store import DocumentMissing, Store
from casegraph.streaming.ingest import CRASHED
from casegraph.streaming.machine import Patience

PLAN = "case_id string, document_id string, path string, position int"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def work(case_id, document_id, path):
    """An extraction record; the path tells what goes wrong."""
    if "broken" in path:
        raise ValueError(f"can't read {path}")
    extraction = dict(file_type="pdf", extracted_text="x", page_count=1, pages_via_text_layer=1, pages_via_vlm=0, orientation_corrections={}, acroform_fields={}, xfa_fields={})
    kinds = dict(document_type="OTHER", generation=None, confidence=1.0, raw_response="OTHER")
    return dict(
        case_id=case_id, document_id=document_id, source_file=path, extraction=extraction, classification=kinds, field_extraction=dict(fields={}, raw_response=""),
        processing_seconds=1.0, model_name="m", extracted_at="2025-01-01T00:00:00Z",
    )


@pytest.fixture
def tables(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def test_rounds(spark, tables):
    rows = [("k", "good", "a.pdf", 1), ("k", "bad", "broken.pdf", 0), ("k", "lost", "lost.pdf", 2)]
    documents = spark.createDataFrame(rows, PLAN)
    with pytest.raises(DocumentMissing):
        process_documents(tables, documents, local_job(work))
    tables.register(documents)
    lossy = lambda df: local_job(work)(df.where("path <> 'lost.pdf'"))
    summary = process_documents(tables, documents, lossy, Drive(2, 2), evaluate=True).collect()
    assert [(r["document_id"], r["stage"], r["attempt_count"], r["error_detail"]) for r in summary] == [
        ("bad", "FAILED", 2, "ValueError: can't read broken.pdf"), ("good", "OCR_DONE", 1, None), ("lost", "FAILED", 2, CRASHED),
    ]
    assert (summary[0]["total"], summary[0]["succeeded"], summary[0]["failed"]) == (3, 1, 2) and tables.snapshots().isEmpty()

    def breaks(_):
        raise OSError("cluster gone")

    process_documents(tables, documents.where("document_id = 'bad'"), breaks, Drive(1, 3)).collect()
    assert tables.document("k", "bad").first()["error_detail"] == f"{CRASHED}: OSError: cluster gone"
    with pytest.raises(ValueError):
        Drive(at_a_time=0)


class Jobs:
    """Jobs that are files of a folder: what a document's name says happens to its job. Time is a number in a file."""

    def __init__(self, folder):
        self.folder = folder

    def _log(self, what, number):
        with open(f"{self.folder}/log", "a") as out:
            out.write(f"{what} {number}\n")

    def now(self):
        with open(f"{self.folder}/time") as source:
            return float(source.read())

    def submit(self, case_id, document_id, path, result):
        import pathlib

        self._log("submit", document_id)
        if document_id == "none":
            raise ConnectionError("no cluster")
        if document_id in ("good", "failed"):
            self.leave(case_id, document_id, path, pathlib.Path(result))
        return document_id

    def leave(self, case_id, document_id, path, target):
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps({"ok": True, "case_id": case_id, "document_id": document_id, "result": work(case_id, document_id, path)}))

    def poll(self, number):
        self._log("poll", number)
        if number == "deaf" or number == "hard" and self.now() < 40:
            raise OSError("no answer")
        return None if number in ("slow", "hard") and self.now() < 1000 + 1e6 * (number == "slow") else "FAILED" if number == "failed" else "SUCCEEDED"

    def stop(self, number):
        self._log("stop", number)


@pytest.mark.parametrize("at_a_time", [100, 3])
def test_remote_jobs(spark, tables, tmp_path, at_a_time):
    spool, jobs = tmp_path / "spool", Jobs(str(tmp_path))
    (tmp_path / "time").write_text("0")
    names = ("good", "none", "silent", "late", "deaf", "hard", "slow", "failed", "a/b")
    documents = spark.createDataFrame([("k", d, f"{d}.pdf", k) for k, d in enumerate(names)], PLAN)
    (spool / "k").mkdir(parents=True)
    (spool / "k" / "silent.json").write_text("of an earlier attempt")
    tables.register(documents)
    rounds = []

    def sleep(seconds):
        """Ten seconds at first, then minutes; the late file comes in the time of grace."""
        rounds.append(seconds)
        now = jobs.now() + (10 if len(rounds) < 12 else 300)
        (tmp_path / "time").write_text(str(now))
        log = (tmp_path / "log").read_text()
        if "poll late" in log and not (spool / "k" / "late.json").exists() and len(rounds) > log[: log.index("poll late")].count("poll silent") + 3:
            jobs.leave("k", "late", "late.pdf", spool / "k" / "late.json")

    job = remote_job(jobs, str(spool), Patience(1800, 120, 5), at_a_time, 10.0, 4, jobs.now, sleep)
    told = {r["document_id"]: (r["stage"], r["error_detail"]) for r in process_documents(tables, documents, job, Drive(3, 1)).collect()}
    assert told == {
        "good": ("OCR_DONE", None), "none": ("FAILED", "launch failed: ConnectionError: no cluster"), "silent": ("FAILED", "the job ended SUCCEEDED without a result file"),
        "late": ("OCR_DONE", None), "deaf": ("FAILED", "the job could not be polled 5 times in a row: OSError: no answer"), "hard": ("FAILED", "the job ended SUCCEEDED without a result file"),
        "slow": ("FAILED", "the job still runs after 1800 s"), "failed": ("OCR_DONE", None), "a/b": ("FAILED", "launch failed: ids that can't be a path"),
    }
    log = (tmp_path / "log").read_text().splitlines()
    assert [x for x in log if x.startswith("stop")] == ["stop slow"] and log.count("poll deaf") == 5 and log.count("submit good") == 1 and set(rounds) == {10.0}
    begun = log[: next(k for k, x in enumerate(log) if x.startswith("poll"))]
    assert len(set(begun) - {"submit none"}) <= at_a_time


def test_service(spark, tables, tmp_path):
    gate = threading.Event()

    def slow(df):
        gate.wait(60)
        return local_job(work)(df)

    runs = CaseRuns(tables, slow)
    s = service.Service(tables, runs, Settings(upload_dir=str(tmp_path / "up")), model="m")
    file = lambda name, content=b"x": (name, io.BytesIO(content))
    refused = [
        (400, " k", [file("a.pdf")]), (400, "k", []), (415, "k", [file("a.doc")]), (400, "k", [file("a.pdf"), file("a.png")]), (400, "k", [file("a.pdf", b"")]), (400, "k", [file(".a.pdf")]),
        (400, "k", [file("a.pdf"), file("a.pdf")]), (400, "k", [file("in/")]), (400, "x" * 201, [file("a.pdf")]), (400, "k", [file("a .pdf")]), (400, "k", [file(None)]),
    ]
    for code, case_id, given in refused:
        with pytest.raises(service.Refused) as e:
            s.upload(case_id, given)
        assert e.value.code == code
    assert list((tmp_path / "up").iterdir()) == []
    with pytest.raises(service.Refused) as e, service.Delivery(str(tmp_path / "up"), "big", most=1) as delivery:
        delivery.take("a.pdf", io.BytesIO(b"xx"))
    assert e.value.code == 413 and list((tmp_path / "up").iterdir()) == []
    now = s.upload("k", [file("C:\\in\\a.pdf"), file("b.pdf")])
    assert now["running"] and not now["interrupted"] and [d["document_id"] for d in now["docs"]] == ["a", "b"] and now["case_label"]["en"] == "Processing"
    assert (tmp_path / "up" / "k" / "a.pdf").read_bytes() == b"x" and [p.name for p in (tmp_path / "up").iterdir()] == ["k"]
    with pytest.raises(Busy):
        runs.submit("k", None)
    with pytest.raises(service.Refused) as e:
        s.upload("k", [file("c.pdf")])
    assert e.value.code == 409 and s.verdict("k")["result"] == "pending" and s.verdict("k")["pending"] == ["a", "b"]
    (tmp_path / "up" / "taken").mkdir()
    with pytest.raises(service.Refused) as e:
        s.upload("taken", [file("c.pdf")])
    assert e.value.code == 409 and (tmp_path / "up" / "taken").exists()
    gate.set()
    runs.submit("none", spark.createDataFrame([("none", "d", "d.pdf", 0)], PLAN)).result(60)  # behind the run of k; not registered, so it breaks off
    assert runs.live() == set()
    server = service.serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda path, *body: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", *body)))
    waits = []
    verdict = service.follow_case(lambda: ask("/api/cases/k"), lambda: ask("/api/cases/k/verdict"), wait=waits.append)
    assert verdict["result"] == "verdict" and verdict["estado"] == "AMARILLO" and waits == [] and len(verdict["docs"]) == 2
    assert ask("/api/health") == {"status": "ok", "model": "m"} and ask("/api/cases")[0]["case_status"] == "RULES_EVALUATED"
    with pytest.raises(urllib.error.HTTPError):
        ask("/api/cases/none")
    form = b"".join(b'--b\r\nContent-Disposition: form-data; name="files"; filename="%s.pdf"\r\n\r\n%s\r\n' % (n, c) for n, c in ((b"p", b"x" * 200_000), (b"q", b"y"))) + b"--b--\r\n"
    put = lambda case_id: ask(f"/api/cases?case_id={case_id}", form, {"Content-Type": "multipart/form-data; boundary=b"})
    assert [d["document_id"] for d in put("posted")["docs"]] == ["p", "q"] and (tmp_path / "up" / "posted" / "p.pdf").stat().st_size == 200_000
    with pytest.raises(urllib.error.HTTPError) as e:
        put("posted")
    assert e.value.code == 409
    server.shutdown()
    runs.close()


class Trickle(io.RawIOBase):
    """A stream that gives a few bytes at a time and tells the most it was asked for."""

    def __init__(self, data):
        self.data, self.most = io.BytesIO(data), 0

    def read(self, n=-1):
        self.most = max(self.most, n)
        return self.data.read(min(n, 7))


@pytest.mark.parametrize("content", [b"", b"\r\n", b"--b", b"\r\n--", bytes(range(256)) * 3])
def test_multipart(content):
    raw = b'preamble\r\n--b \r\nContent-Disposition: form-data; name="n"\r\n\r\nno file\r\n--b\r\nContent-Disposition: form-data; filename="\xc3\xa9.pdf"\r\nX: y\r\n\r\n' + content + b"\r\n--b--\r\nepilogue"
    source = Trickle(raw)
    got = [(name, b"".join(iter(part.read, b""))) for name, part in service.Multipart(source, 'multipart/form-data; boundary="b"', len(raw)).files()]
    assert got == [("é.pdf", content)] and source.most <= service.PIECE
    skipped = [name for name, _ in service.Multipart(Trickle(raw), "multipart/form-data; boundary=b", len(raw)).files()]
    assert skipped == ["é.pdf"]
    for bad in (raw[:60], raw[: raw.rindex(b"\r\n--b--")], b""):
        with pytest.raises(service.Refused):
            list(service.Multipart(Trickle(bad), "multipart/form-data; boundary=b", len(bad)).files())
    with pytest.raises(service.Refused):
        service.Multipart(source, "text/plain", 3)


def test_start_problems():
    port, settings, problems = service.start_problems({})
    assert port is None and len(problems) == 2
    good = {"CASEGRAPH_PORT": "8080", "CASEGRAPH_MODEL_URL": "http://m/v1", "CASEGRAPH_MAX_RUNNING": "2"}
    port, settings, problems = service.start_problems(good)
    assert (port, settings.max_running, problems) == (8080, 2, [])
    assert "MAX_RUNNING" in service.start_problems(good | {"CASEGRAPH_MAX_RUNNING": "0"})[2][0]


def test_command_line(spark, tmp_path, capsys):
    run = lambda *argv, job=local_job(work): (cli.main(["--root", str(tmp_path / "t"), *argv], spark, job), capsys.readouterr())
    assert run("status", "init-db")[1].out.endswith("version 3\n")
    assert run("status", "add-doc", "--case", "k", "--doc", "a")[0] == 0
    code, told = run("status", "add-doc", "--case", "k", "--doc", "a")
    assert code == 1 and "already registered" in told.err
    assert "FAILED  attempt=1" in run("status", "set-stage", "--case", "k", "--doc", "a", "--stage", "FAILED", "--error", "x")[1].out
    code, told = run("orchestrator", "retry-failed", "--case", "k", "--doc", "a=a.pdf")
    assert code == 0 and "OCR_DONE  attempt=2" in told.out
    code, told = run("rules", "show-case", "--case", "k")
    assert code == 1 and "isn't evaluated" in told.err
    assert run("ocr", "show", "--case", "q", "--doc", "zz")[0] == 1 and run("ocr", "run", "--case", "q", "--doc", "c", "--file", "c", job=None)[0] == 1


def test_arguments():
    assert cli.parse_documents(["a=x=y", "b=z"]) == {"a": "x=y", "b": "z"}
    for bad in (["a"], ["=x"], ["a="], ["a=1", "a=2"]):
        with pytest.raises(SystemExit):
            cli.parse_documents(bad)
    assert cli.job_arguments({"JOB_ARGUMENTS": "status 'a b'"}, ["x", "y"]) == ["status", "a b"]
    assert cli.job_arguments({"JOB_ARGUMENTS": " "}, ["x", "y"]) == ["y"] and cli.job_arguments({}, ["x", "-f", "kernel.json"]) == []
    with pytest.raises(SystemExit, match="\\*\\*\\*"):
        cli.job_arguments({}, ["x", "--fake-token", "secret"])


def test_failures_have_details(spark):
    df = spark.createDataFrame([("k", "d", "why")], "case_id string, document_id string, error_detail string")
    assert failures(df).where(F.col("ok")).isEmpty()

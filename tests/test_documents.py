"""Files, forms, pages, model calls: with readers and models that are stand-ins."""

import io
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casegraph.models import client, documents, vision
from casegraph.operators import replies
from casegraph.sources import files

DOC = "case_id string, document_id string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def test_listing(spark, tmp_path):
    for name in ("b.PDF", "a.jpg", ".hidden.pdf", "note.txt", "no suffix"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.pdf").write_bytes(b"x")
    found = files.scan_folder(spark, str(tmp_path)).collect()
    assert [(r["document_id"], r["path"].rsplit("/", 1)[-1]) for r in found] == [("a", "a.jpg"), ("b", "b.PDF")]
    (tmp_path / "a.png").write_bytes(b"x")
    with pytest.raises(files.DuplicateDocument):
        files.scan_folder(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_bytes(b"x")
    with pytest.raises(files.EmptyFolder):
        files.scan_folder(spark, str(tmp_path / "empty"))


def test_file_checks(spark, tmp_path):
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "good.png").write_bytes(b"png")
    (tmp_path / "odd.doc").write_bytes(b"x")
    (tmp_path / "_marked.PdF").write_bytes(b"pdf")
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    read = files.read_documents(spark, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # contents aren't shuffled
    got = {r["path"].rsplit("/", 1)[-1]: (r["content"], r["problem"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got["_marked.PdF"] == (b"pdf", None) and got["good.png"] == (b"png", None) and got["empty.pdf"] == (None, "empty file") and got["odd.doc"] == (None, "unsupported file type .doc")
    limit = files.MOST_MEGABYTES << 20
    sizes = spark.createDataFrame([("a.pdf", limit), ("a.pdf", limit + 1)], "path string, length long")
    assert [r[0] for r in sizes.select(files.file_problem(F.col("path"), F.col("length"))).collect()] == [None, "larger than 50 MB"]


@pytest.mark.parametrize(
    "xml, want",
    [
        (None, {}), (b"", {}), (b"<data><a> 1 </a><b/><a>2</a></data>", {"a": "2"}), (b"<x:datasets xmlns:x='u'><x:k>v</x:k></x:datasets>", {"k": "v"}),
        (b"<form><a>1</a></form>", {}), (b"<template><x>1</x></template><datasets>one</datasets>", {"datasets": "one"}), (b"<broken", {}),
        (b"<template/><data>first</data><datasets>second</datasets>", {"data": "first"}),
    ],
)
def test_xfa(spark, xml, want):
    assert files.xfa_fields(xml) == want
    assert spark.createDataFrame([(xml,)], "x binary").select(files.parse_xfa("x").alias("f")).first()["f"] == want


class _Page:
    def __init__(self, text="", fields=(), broken=False):
        self._text, self._fields, self._broken = text, fields, broken

    def text(self):
        if self._broken:
            raise OSError("no text")
        return self._text

    def widgets(self):
        return self._fields

    def png(self, dpi):
        return f"png at {dpi}".encode()


def _reader(content):
    pages = {
        b"form": [_Page(" " + "t" * 60 + "\n", [("n", " v "), ("n", ""), (None, 3)]), _Page("short", [("n", "w")]), _Page(broken=True)],
        b"none": [], b"mute": [_Page()],
    }
    if content == b"bad":
        raise ValueError("no PDF")
    return pages[content], b"<data><xf>1</xf></data>" if content == b"form" else None


class _Seer:
    def __call__(self, messages, max_tokens, temperature=0.0, extra=None):
        picture = messages[0]["content"][1]["image_url"]["url"]
        return "" if "bXV0ZQ" in picture else f"seen {max_tokens}"


def test_documents_from_files_to_records(spark):
    rows = [("k", d, f"/in/{d}{s}", len(c), c) for d, s, c in (("form", ".pdf", b"form"), ("none", ".pdf", b"none"), ("bad", ".pdf", b"bad"), ("pic", ".png", b"picture"), ("mute", ".png", b"mute"), ("odd", ".doc", b"x"))]
    df = spark.createDataFrame(rows, f"{DOC}, path string, length long, content binary")
    classifier = F.udf(lambda t: "BIRTH_CERT\nG2" if "form" in t.lower() else "OTHER")
    extractor = F.udf(lambda t, k: json.dumps({"Nombre G_X": f"{k} name", "other": 1}))
    got = {r["document_id"]: r for r in documents.process_documents(df, _Seer, classifier, extractor, "m", vision.Reading(dpi=72, max_tokens=9), _reader, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert {d: r["error_detail"] for d, r in got.items() if not r["ok"]} == {
        "none": "ValueError: the PDF has no pages", "bad": "ValueError: no PDF", "mute": "EmptyExtraction: the model returned no text", "odd": "ValueError: unsupported file type .doc",
    }
    form = got["form"]["result"]
    assert form["extraction"]["acroform_fields"] == {"n": "v", "unnamed_field_page0_2": "3", "n_p2": "w"} and form["extraction"]["xfa_fields"] == {"xf": "1"}
    assert (form["extraction"]["page_count"], form["extraction"]["pages_via_text_layer"], form["extraction"]["pages_via_vlm"]) == (3, 1, 2)
    text = form["extraction"]["extracted_text"]
    assert text.endswith("--- Page 1 [text layer] ---\n" + "t" * 60 + "\n\n--- Page 2 ---\nseen 9\n\n--- Page 3 ---\nseen 9") and "**n_p2**: w" in text
    assert (form["classification"]["document_type"], form["classification"]["generation"]) == ("BIRTH_CERT", "G2")
    assert form["field_extraction"]["fields"] == {"nombre": "BIRTH_CERT name"} and form["source_file"] == "form.pdf" and form["extracted_at"] == "2025-01-01T00:00:00Z"
    picture = got["pic"]["result"]
    assert picture["extraction"]["extracted_text"] == "seen 9" and picture["extraction"]["file_type"] == "image" and picture["field_extraction"]["fields"] == {}


def test_files_are_opened_once_and_calls_overlap(spark, tmp_path):
    log = str(tmp_path / "opened")

    def reader(content):
        with open(log, "a") as out:
            out.write(content.decode() + "\n")
        return [_Page() for _ in range(12)], None

    class Slow:
        def __init__(self):
            import threading

            self.now, self.most, self.calls, self.lock = 0, 0, 0, threading.Lock()

        def __call__(self, messages, max_tokens, temperature=0.0, extra=None):
            import time

            with self.lock:
                self.calls += 1
                number, self.now = self.calls, self.now + 1
                self.most = max(self.most, self.now)
            time.sleep(0.05 if number % 2 else 0.01)
            with self.lock:
                self.now -= 1
            if number == 5:
                raise OSError("once")
            return f"call {number} of {self.most}"

    df = spark.createDataFrame([("k", d, f"/in/{d}.pdf", 1, d.encode()) for d in "ab"], f"{DOC}, path string, length long, content binary").coalesce(1)
    pages = documents.read_pages(df, Slow, vision.Reading(), reader, client.Calls(4, 2, 1, 0.0))
    assert pages._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = pages.collect()
    assert [(r["document_id"], r["number"]) for r in rows] == [(d, n) for d in "ab" for n in range(1, 13)] and open(log).read() == "a\nb\n"
    assert all(r["error_detail"] is None for r in rows) and max(int(r["text"].split()[-1]) for r in rows) == 4


def test_one_call_fails_alone():
    tried = []

    def call(which):
        def run(_):
            tried.append(which)
            if which == "bad" or which == "once" and tried.count("once") == 1:
                raise OSError(which)
            if which == "refused":
                raise client.Unauthorised("401")
            return which

        return run

    asker = client.Asker(lambda: None, client.Calls(2, 3, 3, 0.0))
    told = list(client.in_order(["a", "once", "bad", "refused", "b"], lambda w: asker.ask(call(w)), 2))
    assert told == [("a", None), ("once", None), (None, "OSError: bad"), (None, "Unauthorised: 401"), ("b", None)]
    assert (tried.count("once"), tried.count("bad"), tried.count("refused")) == (2, 3, 1)
    assert asker.ask(call("bad")) == (None, "OSError: bad") and tried.count("bad") == 4  # the budget is used up
    with pytest.raises(ValueError):
        client.Calls(width=0)


def test_rotation_and_pictures():
    calls = []

    def seer(messages, max_tokens, temperature=0.0, extra=None):
        calls.append((max_tokens, extra))
        return "Rotate_90!" if max_tokens == 16 else "text"

    assert vision.read_picture(seer, b"p", True, vision.Reading()) == ("text", "NONE")
    assert calls == [(2500, {"chat_template_kwargs": {"enable_thinking": False}})]
    assert [vision.rotation_of(x) for x in ("rotate_180", "It is ROTATE_270.", "none", "upside", "")] == ["ROTATE_180", "ROTATE_270", "NONE", "NONE", "NONE"]

    class Picture:
        def rotate(self, by, expand=False):
            return by, expand

    p = Picture()
    assert [vision.turned(p, x) for x in vision.LABELS] == [p, (90, True), (180, False), (270, True)]


def test_client_retries_once_with_a_fresh_token():
    seen = []

    def post(url, token, body):
        seen.append((url, token))
        if token in ("old", "bad"):
            raise client.Unauthorised("401")
        return {"choices": [{"message": {"content": " yes \n" if body["max_tokens"] else None}}]}

    c = client.ChatClient("http://m/v1/", "m", client.TokenList(["old", "new"]), post)
    assert c([], 5) == "yes" and c([], 0) == "" and [t for _, t in seen] == ["old", "new", "new"] and seen[0][0] == "http://m/v1/chat/completions"
    with pytest.raises(client.Unauthorised, match="fresh token"):
        client.ChatClient("u", "m", client.TokenList(["old", "bad"]), post)([], 5)
    with pytest.raises(client.TokenError):
        client.TokenList([])()


def test_token_file(tmp_path):
    path = tmp_path / "t"
    for content, problem in ((None, "no token file"), ("{secret", "can't be read"), ('{"x": 1}', "holds no"), ('{"access_token": " "}', "holds no")):
        if content is not None:
            path.write_text(content)
        with pytest.raises(client.TokenError, match=problem) as e:
            client.TokenFile(str(path))()
        assert "secret" not in str(e.value)
    path.write_text('{"access_token": " abc "}')
    assert client.TokenFile(str(path))() == "abc"


def test_models_for_replies(spark):
    make = lambda: lambda messages, most, temperature=0.0, extra=None: messages[0]["content"] + str(most)
    row = spark.createDataFrame([("text", "ID_DOCUMENT")], "t string, k string")
    assert row.select(client.asked_of(make, "<{text}>", 3)(F.col("t"))).first()[0] == ("<text>3", None)
    assert row.select(client.asked_by_type(make, {"ID_DOCUMENT": "id {text} "}, 4)(F.col("t"), F.col("k"))).first()[0] == ("id text 4", None)

    def breaks():
        raise OSError("no service")

    docs = row.select(F.col("t").alias("extracted_text"), F.lit("k").alias("case_id"), F.lit("d").alias("document_id"))
    docs = docs.withColumn("extracted_text", F.repeat("extracted_text", 100))
    assert replies.classify(docs, client.asked_of(breaks, "{text}", 3, how=client.Calls(tries=1))).first()["model_error"] == "OSError: no service"


def test_pictures_need_a_library_or_are_turned():
    try:
        from PIL import Image
    except ImportError:
        with pytest.raises(RuntimeError, match="Pillow"):
            vision.read_picture(lambda *_: "", b"x", False, vision.Reading())
        return
    out = io.BytesIO()
    Image.new("RGB", (2, 1)).save(out, format="JPEG")
    assert vision.read_picture(lambda *_: "t", out.getvalue(), False, vision.Reading()) == ("t", "NONE")

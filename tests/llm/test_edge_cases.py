"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for operators and stages."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casegraph.llm import chat, common, fingerprint, html_dom, html_extract, language_id, license_scan, packing, quality, sentencepiece_codec, simhash, topk
from casegraph.llm import queries as Q

LONG = "wort " * 40_000 + "x" * 5000
#: Extra columns with the names that operators give to what they add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, row string, `_text` string, piece int, fingerprint string, y int"
ROWS = [
    (1, "One two three four five six", "en", "web"), (1, "One two three four five six", "en", "web"), (2, None, None, None), (None, "Null id text", "en", "web"), (None, None, "de", None), (3, "", "en", ""),
    (4, " \n\t", None, "web"), (5, LONG, "de", "web"), (6, "½ ² Ⅷ 12", "en", "web"), (7, "Das ist ein Text", "de", None), (8, "One two three four five six", "en", "web"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0.5, 1, "r", "t", 1, "f", 1) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_packing(docs, none):
    rows = packing.pack_documents(docs, Q.tokenizer_path(Q.TOKENIZER)).collect()
    assert _ids(r for r in rows if r["piece"] == 0) == ALL_IDS and sum(r["length"] for r in rows if r["doc_id"] == 5) > 40_000
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]


def test_sentencepiece(docs, none):
    rows = sentencepiece_codec.round_trip(docs, Q.tokenizer_path(Q.PIECE_MODEL)).collect()
    assert _ids(rows) == ALL_IDS and all(r["exact"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert sentencepiece_codec.round_trip(none, Q.tokenizer_path(Q.PIECE_MODEL)).count() == 0


def test_pairs_encode_to_themselves_as_merging_tells():
    c, rng = sentencepiece_codec.codec(Q.tokenizer_path(Q.PIECE_MODEL)), random.Random(3)
    stable = [p for p in c.score if c.stable[c.id[p]]]
    pairs = [(rng.choice(stable), rng.choice(stable)) for _ in range(4000)] + [("▁" * a, "▁" * b) for a in (1, 2, 3, 8) for b in (1, 2, 7)]
    got = c._agree(np.array([c.id[a] for a, _ in pairs]), np.array([c.id[b] for _, b in pairs]))
    assert got.tolist() == [c.merge(a + b) == [a, b] for a, b in pairs]


def test_decoding_bytes_and_unknown_pieces():
    from sentencepiece import SentencePieceProcessor

    path = Q.tokenizer_path(Q.PIECE_MODEL)
    sp, c, rng = SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path), random.Random(4)
    ids = [[rng.choice([0, 1, 2, 3, 100, 198, 227, 250, 29871, 29900]) for _ in range(rng.randint(0, 7))] for _ in range(400)]
    assert c.decode(pa.array([*ids, None, [None, 300]], pa.list_(pa.int32()))).to_pylist() == [*map(sp.decode, ids), None, sp.decode([300])]
    with pytest.raises(ValueError):
        c.decode(pa.array([[1 << 20]], pa.list_(pa.int32())))


def _digest(raw: bytes) -> str:
    """The digest once more, triplet by triplet."""
    counts, data = [0] * 256, raw.ljust(4, b"\0") if raw else b""
    for at in range(len(data) - 3):
        a, b, c, d = data[at : at + 4]
        for k, (x, y) in enumerate(((b, c), (a, c), (a, b))):
            counts[(((x << 16 | y << 8 | d) ^ (k << 24)) * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[k] & 0xFFFFFFFF) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    levels = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    body = bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*(levels[k::4] for k in range(4)), strict=True))
    head = [min(255, round(8 * np.log2(1 + len(raw)))), *(int(255 * q / q3) if q3 else 0 for q in (q1, q2))]
    return (bytes(head) + body).hex()


def _likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    apart = [abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[3:], y[3:], strict=True) for s in (0, 2, 4, 6)]
    steps = sum(d + 2 * (d == 3) for d in apart) + min(60, abs(x[0] - y[0])) + (abs(x[1] - y[1]) + abs(x[2] - y[2])) // 16
    return 1 - min(steps, fingerprint.BOUND) / fingerprint.BOUND


def test_fingerprints_once_more(spark, docs, none):
    rng = random.Random(5)
    texts = {k: "".join(rng.choice("ab é\n中") for _ in range(rng.choice((0, 1, 3, 4, 5, 60, 900)))) for k in range(60)}
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, text in texts.items():
        after = texts[(k - 1) % 60]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r, own, edited = rows[k], _digest(text.encode()), _digest(new.encode())
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), own, edited) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == pytest.approx((_likeness(own, edited), _likeness(own, _digest(after.encode()))))
    got = fingerprint.fingerprint(docs).collect()
    assert _ids(got) == ALL_IDS and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 8)}) == 1


def test_licences(docs, none):
    rows = license_scan.scan(docs).collect()
    assert _ids(rows) == ALL_IDS and {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0} and all(r["labels"] == "" for r in rows)


@pytest.mark.parametrize("end", ["", " ", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "  ", "  \n"])
def test_words_before_line_ends(spark, end):
    import re

    text = f"{end}CC{end if end.strip() != end or not end else ' '}By. {end}"
    got = spark.createDataFrame([(text,)], "text string").select(license_scan.words_of(F.col("text")).alias("w")).first()["w"]
    assert got == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_all_notices_at_once(spark):
    text = ". ".join(t.text for t in license_scan.TEMPLATES)
    got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"].split(",") == sorted({t.label for t in license_scan.TEMPLATES})


def test_languages(docs, none):
    model = language_id.train(docs, F.lit(True))
    rows = language_id.identify(docs, model).collect()
    assert _ids(rows) == ALL_IDS and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 6)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 5)} == {"en", "de"}
    assert language_id.identify(none, model).count() == 0


def test_long_texts_count_alike(spark, docs, monkeypatch):
    model = language_id.train(docs, F.lit(True))
    texts = ["Das ist ein Text und mehr " * 30, "One two three " * 50 + "vier fünf sechs " * 50, "ß"]
    plain = language_id.infer(texts, model)
    monkeypatch.setattr(language_id, "LONG", 20)
    for a, b in zip(plain, language_id.infer(texts, model), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-3)
    assert np.array_equal(language_id.trigram_counts(texts[1], step=7), language_id.trigram_counts(texts[1]))


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert _ids(rows) == ALL_IDS and {r["component_id"] for r in rows if r["doc_id"] in (1, 8)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (5, 0), (None, 1), (2, None), (3, 5)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert _ids(rows) == ALL_IDS and {r["quality_score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0} and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.train(none, labels) is None or quality.score(none, quality.train(none, labels)).count() == 0
    assert quality.train(docs, labels.where("quality = 1")) is None


def test_topk_ties_and_bad_vectors(spark):
    rows = [(k, [1.0, 2.0]) for k in range(12)] + [(50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, [float("inf")]), (None, [1.0]), (3, [1.0, 2.0]), (54, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, k, k, 327680) for k in range(1, 6)]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, "yes"), (None, None, None, None), (3, None, "user", "<|im_end|>"), (3, None, "user", "b")]
    got = chat.collapse_and_render(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, k int")).collect()
    assert sorted((r["conv_id"] is None, r["conv_id"], r["turn_index"], r["n_turns"]) for r in got)[:4] == [(False, 2, 0, 2), (False, 2, 1, 2), (False, 3, 0, 2), (False, 3, 1, 2)]
    assert not any("<|im_end|>b" in r["rendered"] for r in got)


PAGES = {
    "": "", None: "", "<p>x": "x", "a &lt;b&gt;  c": "a <b> c", "<script>var a='</p>'</script><p>Some words.": "Some words.",
    "<article><h1>Title here</h1><p>A first paragraph of some length, with a comma.</p><p>Yes.</p><p>See <math><mi>E</mi><mo>=</mo><mn>2</mn></math> there, in the second one.</p></article>":
        "Title here\nA first paragraph of some length, with a comma.\nYes.\nSee E=2 there, in the second one.",
    "<nav class=menu><ul><li><a href=/>Home</a><li><a href=/b>About us</a><li><a href=/c>News</a></ul></nav><main><p>The story began long ago, in a town by the river, and went on.</p><p>It ended well, as all agreed.</p></main><footer>&copy; 2020 Site. All rights.</footer>":
        "The story began long ago, in a town by the river, and went on.\nIt ended well, as all agreed.",
}


def test_pages_of_another_hand(spark):
    rows = [(k, f"u{k}", page, "extra") for k, page in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[k]["text"] for k in range(len(rows))] == list(PAGES.values()) and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_article_blocks(spark, sf_dir):
    """The text of each page of the table is what stands below its article element, block by block."""
    import html
    import re

    for r in html_extract.extract(common.table(spark, sf_dir, "pages")).join(common.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        part = re.split(r"</?article[^>]*>", r["html"])[1].replace("<br>", " ")
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h\d|ul|li|div)[^>]*>", part))
        assert r["text"] == "\n".join(filter(None, blocks))


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 350_000 + ">", '<a href="' * 110_000, "<p class=\"x'>y " * 70_000, "<div>" * 30_000 + "</p>" * 30_000, "<noscript>" * 100_000, "<!--" * 250_000, "< " * 500_000])
def test_broken_pages_end_soon(page):
    import time

    begin = time.monotonic()
    html_dom.parse(page)
    assert time.monotonic() - begin < 5


def test_trees_are_those_of_the_generator():
    with np.load(html_extract.FILE) as f:
        assert int(f["made"]) == html_extract.fingerprint()


def test_pipeline_stages(spark, docs, none, sf_dir):
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == names and stage(spark, none, sf_dir).count() == 0
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert _ids(kept) == [1, 2, 5, 6, 7, None]
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, sf_dir).collect()} == {1, 5, 7, 8, None}
    assert corpus_pipeline.packing_stage(spark, none, sf_dir).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

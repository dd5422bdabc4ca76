"""The ten operators on whole small tables, against brute force, exact round trips, held-out labels, or SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from casegraph.llm import queries as Q


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").df()


def _run(spark, sf_dir, name):
    return [r.asDict() for r in Q.queries()[name](spark, sf_dir).collect()]


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path(Q.TOKENIZER))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in zip(docs.doc_id, docs.text, strict=True)}
    rows, seen, places = _run(spark, sf_dir, "op1_best_fit_packing"), defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        assert sorted(seen[d]) == [(k, s, min(4096, len(x) - s)) for k, s in enumerate(range(0, len(x), 4096))]
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(map(len, ids.values())) // 4096)
    assert len(places) <= least * 1.02 + 1


def _same_as_sql(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = _run(spark, sf_dir, name)
    key = lambda r: str([str(r[c]) for c in sorted(r)])
    assert sorted(map(key, got)) == sorted(key(dict(zip(want.columns, r, strict=True))) for r in want.fetchall())


def test_topk(spark, sf_dir):
    _same_as_sql(spark, sf_dir, "op2_exact_topk", "embeddings")


def test_chat(spark, sf_dir):
    _same_as_sql(spark, sf_dir, "op7_chat_formatting", "conversations")


def test_sentencepiece(spark, sf_dir, docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path(Q.PIECE_MODEL))
    rows = {r["doc_id"]: r for r in _run(spark, sf_dir, "op3_sentencepiece")}
    assert len(rows) == len(docs) and all(r["exact"] for r in rows.values())
    for d, x in zip(docs.doc_id, docs.text, strict=True):
        ids = p.encode(x or "")
        assert (rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fingerprint(spark, sf_dir, docs):
    texts = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    order = sorted(texts, reverse=True)
    after = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    by_text = defaultdict(set)
    for r in _run(spark, sf_dir, "op4_fingerprints"):
        text, other = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_html(spark, sf_dir):
    rows = _run(spark, sf_dir, "op5_html_extraction")
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == "" for r in rows) < len(rows) / 4
    assert not any("<script" in r["text"] or re.search(r"[ \t]{2}", r["text"]) for r in rows)


def test_license(spark, sf_dir, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = {r["doc_id"]: r for r in _run(spark, sf_dir, "op6_license_scan")}
    for d, x in zip(docs.doc_id, docs.text, strict=True):
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[d]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(hits), ",".join(sorted({h[1] for h in hits})))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_language(spark, sf_dir, docs):
    langs = dict(zip(docs.doc_id, docs.lang, strict=True))
    rows = _run(spark, sf_dir, "op8_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    judged = [r for r in rows if r["held_out"] and isinstance(langs[r["doc_id"]], str) and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in judged]) > 0.9


def test_simhash(spark, sf_dir, docs):
    prints = {}
    for d, x in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        count = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
        prints[d] = sum(1 << b for b in range(64) if count[b] * 2 > len(shingles))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in _run(spark, sf_dir, "op9_simhash_golay")}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_quality(spark, sf_dir):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = _run(spark, sf_dir, "op10_quality_classifier")
    pairs = [(r["quality_score"], labels[r["doc_id"]]) for r in rows if labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    from casegraph.llm import chat, fingerprint, language_id, license_scan, packing, simhash, topk

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert packing.pack_documents(none, Q.tokenizer_path(Q.TOKENIZER)).count() == 0
    assert fingerprint.fingerprint(none).count() == license_scan.scan(none).count() == simhash.near_duplicates(none).count() == 0
    assert language_id.identify(none, language_id.train(none, F.lit(True))).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0 < len(kept) < len(docs)
    first = docs[docs.text.notna()].groupby("text").doc_id.min()
    assert kept & set(docs.doc_id) == kept and len(kept) <= len(first)

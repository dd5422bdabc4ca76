"""Vector codes and clusters against brute force and SQL; nulls, odd lengths, ties, repeated rows, empty tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from casegraph.llm import clustering, common, vector_codes, vectors
from casegraph.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, x string, `_key` string, error long"


def _frame(spark, rows):
    return spark.createDataFrame([(i, e, y, 0, "x", "k", 1) for i, e, y in rows], SCHEMA)


def _floors(e, scale):
    return [math.floor(scale * x) for x in e]


def _nearest(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))


def _moved(book, own):
    return [[sum(c) // len(o) for c in zip(*o, strict=True)] if (o := own.get(k)) else b for k, b in enumerate(book)]


def codes_by_hand(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, _floors(e, scale), y) for i, e, y in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max(1, -(-max([0, *(len(e) for _, e, _ in kept)]) // parts))
    kept = sorted(((i, e + [0] * (width * parts - len(e)), y) for i, e, y in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda e, p: e[p * width : (p + 1) * width]
    books = [[cut(e, p) for _, e, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, e, _ in kept:
                own.setdefault(_nearest(cut(e, p), books[p])[1], []).append(cut(e, p))
            books[p] = _moved(books[p], own)
    out = []
    for i, e, y in kept:
        found = [_nearest(cut(e, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(2**63 - 1, sum(d for d, _ in found)), y))
    text = ",".join(str(c) for b in books for entry in b for c in entry)
    by = {}
    for _, _, error, y in out:
        by[y] = min(2**63 - 1, by.get(y, 0) + error)
    return sorted(((i, c, e, by[y], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, y in out), key=str)


def clusters_by_hand(rows, k=8, rounds=10, scale=1024, dimensions=64):
    kept = [(i, _floors(e, scale)) for i, e, _ in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [e for _, e in sorted(kept, key=drawn)[:k]]
    for _ in range(rounds):
        own = {}
        for _, e in kept:
            own.setdefault(_nearest(e, centres)[1], []).append(e)
        centres = _moved(centres, own)
    found = [(i, *_nearest(e, centres)) for i, e in kept]
    sums = {}
    for _, d, c in found:
        sums[c] = sums.get(c, 0) + d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashes[c]) for i, d, c in found), key=str)


def _vectors(seed, n, d=64, spread=5, hot=0.34):
    """Clumped vectors, whole and half steps for ties; a third of the rows are one vector."""
    rng = random.Random(seed)
    clumps = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(spread)]
    one = [0.25] * d
    rows = [(i, one if rng.random() < hot else [round((c + rng.gauss(0, 0.1)) * 16) / 16 for c in rng.choice(clumps)], rng.choice((0, 0, 0, 1, 2, None))) for i in range(n)]
    odd = [
        (7, rows[7][1], 1), (7, rows[3][1], 1), (None, rows[5][1], None), (10_000, None, 1), (10_001, [], 2), (10_002, [None] * d, 1), (10_003, [float("nan")] + [0.0] * (d - 1), 1),
        (10_004, [float("inf")] * d, 1), (-5, [-0.001] * d, None), (10_005, [1e-9] * d, 0),
    ]
    return rows + odd


def _got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("seed", range(3))
def test_codes_as_brute_force(spark, seed):
    rows = _vectors(seed, 300, d=64 if seed else 40)
    got = vector_codes.digest(vector_codes.encode(_frame(spark, rows).repartition(3)))
    assert got.columns == list(CODES) and _got(got, *CODES) == codes_by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_as_brute_force(spark, seed):
    rows = [*_vectors(seed, 300), (20_000, [0.5] * 63, 1), (20_001, [0.5] * 65, 1)]
    got = clustering.digest(clustering.cluster(_frame(spark, rows).repartition(3)))
    assert got.columns == list(CLUSTERS) and _got(got, *CLUSTERS) == clusters_by_hand(rows)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clusters"])
def test_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    assert _got(Q.queries()[name](spark, sf_dir), *want.columns) == sorted(want.fetchall(), key=str)


def test_large_components(spark):
    """Beyond what doubles hold: distances and sums stay exact."""
    rows = [(i, [float((-1) ** i * 2**30 * (1 + i % 3)), float(i % 2), *[0.0] * 62], i % 2) for i in range(40)]
    assert _got(vector_codes.digest(vector_codes.encode(_frame(spark, rows), entries=5)), *CODES) == codes_by_hand(rows, entries=5)
    got = _got(clustering.digest(clustering.cluster(_frame(spark, rows), clusters=3)), *CLUSTERS)
    want = clusters_by_hand(rows, k=3)
    top = 2**63 - 1
    assert got == sorted(((i, c, *(min(top, v) for v in x), h) for i, c, *x, h in want), key=str)


def test_empty_and_few(spark):
    none = _frame(spark, [])
    assert vector_codes.digest(vector_codes.encode(none)).collect() == [] and clustering.digest(clustering.cluster(none)).collect() == []
    one = [(3, [0.5] * 64, None)]
    assert _got(vector_codes.digest(vector_codes.encode(_frame(spark, one))), *CODES) == codes_by_hand(one)
    assert _got(clustering.digest(clustering.cluster(_frame(spark, one))), *CLUSTERS) == clusters_by_hand(one)


def test_exponion_looks_at_less_than_all():
    rng = np.random.default_rng(1)
    book = rng.integers(-200, 200, (64, 4))
    x = book[rng.integers(0, 64, 5000)] + rng.integers(-9, 10, (5000, 4))
    before = vectors.squares(x, book).argmin(axis=1)
    code, distance, looked = vector_codes.exponion(x, before, book)
    squared = vectors.squares(x, book)
    assert (code == squared.argmin(axis=1)).all() and (distance == squared.min(axis=1)).all() and looked < 64 * 5000 / 4


def test_bounds_spare_scans(spark):
    rows = [r for r in _vectors(5, 400, hot=0.0) if r[1] and len(r[1]) == 64]
    found = clustering.cluster(_frame(spark, rows))
    assert found.scans[0] >= 400 and sum(found.scans[1:]) < 5 * found.scans[0] and found.scans[-1] < found.scans[0] / 2


def test_decode(spark):
    rows = _vectors(2, 50)
    coded = vector_codes.encode(_frame(spark, rows))
    r = coded.rows.where("vec_id = 20").first()
    back = vector_codes.decode(r["codes"], coded.codebooks)
    assert sum((math.floor(256 * b) - math.floor(256 * x)) ** 2 for b, x in zip(back, rows[20][1], strict=True)) == r["error"]


def test_totals_by_shuffle(spark, monkeypatch):
    """Hot keys by broadcast, the others by shuffle; null is a key."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT", 4)
    keys = ["a"] * 60 + [None] * 30 + ["b", "c", "c", "-", "=a"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    totals = rows.where("k != 'b' or k is null").groupBy("k").agg({"i": "count"}).withColumnRenamed("count(i)", "n").selectExpr("k", "n", "n * 10 as t")
    got = {r["i"]: r["t"] for r in common.with_totals(rows, totals, "k").collect()}
    assert got == {i: None if k == "b" else 10 * keys.count(k) for i, k in enumerate(keys)}

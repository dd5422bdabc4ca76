"""Vector codes: each vector's parts as entries of small codebooks, assigned by exponion search.

A part keeps its entry from round to round, so the next search starts there: with d the distance to that entry, no entry
further than 2d from it can be nearer, nor as near (triangle inequality; on squares of whole numbers, D <= 4 D0, exact).
Entries' neighbours are sorted by distance, so those to look at are the beginning of a list. Distances are whole numbers;
of equally near entries the one with the smaller index counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm import vectors as V
from casegraph.llm.common import drop, stash, with_totals

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Pairs of a part and an entry that are looked at together.
PAIRS = 1 << 20
STATE = "vec_id long, label string, x array<long>, codes array<int>, error long"


@dataclass
class Coded:
    """codebooks[part][entry][component], and rows (vec_id, label, codes, error) of all vectors that take part."""

    codebooks: list[list[list[int]]]
    rows: DataFrame


def exponion(x: np.ndarray, before: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of `book` and its squared distance for each row of x, and how many pairs were looked at."""
    entries, bound = len(book), x.shape[1] * (2 * V.greatest(x, book)) ** 2
    number = V.kind((4 * bound + 1) * entries)
    x, book = x.astype(number), book.astype(number)
    apart = V.squares(book, book).astype(number)
    near = np.argsort(apart, axis=1, kind="stable")
    sorted_apart = np.take_along_axis(apart, near, axis=1)
    radius = 4 * ((x - book[before]) ** 2).sum(axis=1)
    reach = np.empty(len(x), np.int64)
    for entry in np.unique(before):
        own = before == entry
        reach[own] = np.searchsorted(sorted_apart[entry], radius[own], side="right")
    code, distance = np.empty(len(x), np.int64), np.empty(len(x), number)
    ends = np.cumsum(reach)
    a = 0
    while a < len(x):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        lengths = reach[a:b]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rows = np.repeat(np.arange(a, b), lengths)
        candidates = near[before[rows], np.arange(len(rows)) - np.repeat(starts, lengths)]
        key = ((x[rows] - book[candidates]) ** 2).sum(axis=1) * entries + candidates  # ties to the smaller index
        best = np.minimum.reduceat(key, starts)
        code[a:b], distance[a:b] = best % entries, best // entries
        a = b
    return code, distance, int(ends[-1]) if len(ends) else 0


def _assign(books: list[list[list[int]]], width: int, first: bool):
    tables = [np.array(b, object).reshape(len(b), width) for b in books]
    tables = [t.astype(np.int64) for t in tables]
    entries = len(books[0])

    def step(block: pa.Table, sums: V.Sums) -> dict[str, pa.Array]:
        x = V.matrix(block, width * len(tables))
        n = len(x)
        before = np.zeros((n, len(tables)), np.int64) if first else np.asarray(block.column("codes").combine_chunks().flatten(), np.int64).reshape(n, len(tables))
        codes, error = np.empty((n, len(tables)), np.int32), np.zeros(n, object)
        for p, book in enumerate(tables):
            part = x[:, p * width : (p + 1) * width]
            code, distance, _ = exponion(part, before[:, p], book)
            codes[:, p] = code
            error += distance.astype(object)
            sums.add(p * entries + code, part)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(tables))
        return {"codes": pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), "error": pa.array(V.clamped(error), pa.int64())}

    return step


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> Coded:
    """Codebooks fitted on all vectors in `rounds` rounds, and each vector's codes by the last of them.

    Rows whose vector is null or holds null or non-finite components take no part; other columns are ignored. Components
    become floor(scale * x), held at a long's ends. Vectors that are shorter than the longest, and lengths that `parts`
    doesn't divide, are filled up with zeros. Codebooks start as the parts of the rows with the smallest ids (null ids
    last; repeated rows and ids count as often as they stand, in the order of their components), fewer than `entries`
    where there are fewer rows. Errors beyond a long are held at its end. An empty table gives empty codebooks and no rows.
    """
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where(V.usable(F.col("x"))).withColumn("x", V.whole(F.col("x"), scale))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    missing = F.lit(width * parts) - F.size("x")
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing)))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = [[list(s["x"][p * width : (p + 1) * width]) for s in seeds] for p in range(parts)]
    none = F.array().cast("array<int>").alias("codes")
    state, path = rows.select("vec_id", "label", "x", none, F.lit(0).cast("long").alias("error")), None
    if not seeds:
        return Coded(books, state.drop("x"))
    for k in range(rounds + 1):
        now, new = stash(V.one_pass(state, STATE, _assign(books, width, k == 0), parts * len(seeds), width), "vector-codes")
        if path:
            drop(now.sparkSession, path)
        state, path = now.where(F.col("cell").isNull()), new
        if k < rounds:
            flat = V.moved([e for b in books for e in b], V.gathered(now))
            books = [flat[p * len(seeds) : (p + 1) * len(seeds)] for p in range(parts)]
    return Coded(books, state.select("vec_id", "label", "codes", "error"))


def decode(codes: list[int], codebooks: list[list[list[int]]], scale: float = SCALE) -> list[float]:
    """The vector that codes stand for: its entries' components over `scale`."""
    return [c / scale for code, book in zip(codes, codebooks, strict=True) for c in book[code]]


def digest(coded: Coded) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and the
    sha256 of all entries' components of the codebooks."""
    text = ",".join(str(c) for book in coded.codebooks for entry in book for c in entry)
    labels = coded.rows.groupBy("label").agg(F.count("*").alias("n"), V.long_sum("error").alias("label_error"))
    hexes = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    told = with_totals(coded.rows.select("vec_id", "label", hexes.alias("code"), "error"), labels, "label")
    return told.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))

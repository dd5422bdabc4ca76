"""Document fingerprints as quartile bucket digests.

A text's bytes give triplets, from a window of four bytes: three of them with the window's last. Each triplet is hashed
to one of 256 buckets and counted. The digest holds, for each bucket, in which quartile its count lies (two bits), and
a head of the length on a logarithmic scale and of two quartile ratios. Digests are compared by the steps between
their quartiles and heads, up to a bound beyond which texts count as wholly unlike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, stash

BUCKETS = 256
#: Difference from which texts count as wholly unlike.
BOUND = 400
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(raw: bytes, step: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte triplets; a text of fewer than four bytes is filled up with zero bytes."""
    out = np.zeros(BUCKETS, np.int64)
    if not raw:
        return out
    whole = np.frombuffer(raw.ljust(4, b"\0"), np.uint8)
    for at in range(0, len(whole) - 3, step):
        b = whole[at : at + step + 3].astype(np.uint32)
        a, b, c, d = b[:-3], b[1:-2], b[2:-1], b[3:]
        for k, (x, y) in enumerate(((b, c), (a, c), (a, b))):
            mixed = (x << np.uint32(16)) | (y << np.uint32(8)) | d
            mixed = (mixed ^ np.uint32(k << 24)) * _MULTIPLIERS[k]
            out += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(raw: bytes) -> str:
    """Fingerprint of a text's UTF-8 bytes: 6 hex digits of head and 128 of quartiles."""
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (level[0::4] << 6) | (level[1::4] << 4) | (level[2::4] << 2) | level[3::4]
    size = min(255, round(8 * np.log2(1 + len(raw))))
    ratios = [0 if not q3 else int(255 * q / q3) for q in (q1, q2)]
    return bytes([size, *ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Steps between two digests; 0 for equal ones."""
    x, y = (np.frombuffer(bytes.fromhex(t), np.uint8) for t in (a, b))
    levels = [(z[3:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3 for z in (x, y)]
    apart = np.abs(levels[0].astype(np.int16) - levels[1])
    head = np.abs(x[:3].astype(np.int16) - y[:3])
    return int((apart + 2 * (apart == 3)).sum() + min(60, head[0]) + (head[1] + head[2]) // 16)


def likeness(a: str, b: str, bound: int = BOUND) -> float:
    """1 for equal digests, 0 from `bound` steps on."""
    return 1 - min(difference(a, b), bound) / bound


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the beginning of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, print_: str, after: str, after_print: str) -> tuple:
    new = edited(text, after)
    raw = new.encode("utf-8", "replace")
    new_print = digest(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, after_print)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of `docs`.

    The edited text takes its end from the next document in descending doc_id, the last one from the first. Rows of
    equal doc_id follow by their text's hash, then text; null ids come last. A null text is empty. A single row is its
    own next. Empty tables give an empty result, other columns are ignored.

    Rows are range-partitioned in that order once, and each partition is one pass that holds two texts. A partition's
    last row needs the next partition's first: those two rows of each partition keep their texts and meet in a join.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("at"), F.col("text")]
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")

    def run(batches):
        first = last = None  # (part, doc, text, print)
        for batch in batches:
            out: list[tuple] = []
            for doc, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (part, doc, text, digest(text.encode("utf-8", "replace")))
                first = first or now
                if last:
                    out.append((*_row(last[1], last[2], last[3], text, now[3]), None, None, None))
                last = now
            yield _batch(out)
        if last:
            ends = [first, last]
            yield _batch([(x[1], None, None, x[3], None, None, None, x[0], k, x[2]) for k, x in enumerate(ends)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 10
        kinds = [*_KINDS, pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [*_NAMES, "part", "end", "text"])

    told, _ = stash(dealt.mapInArrow(run, f"doc_id long, {FIELDS}, part int, end int, text string"), "fingerprints")
    ends = told.where(F.col("end").isNotNull())
    parts = sorted(r["part"] for r in ends.where(F.col("end") == 0).select("part").collect())  # one number a partition
    if not parts:
        return told.select(*_NAMES)
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next int")
    heads = ends.where(F.col("end") == 0).select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    tails = ends.where(F.col("end") == 1).join(follows, "part").join(heads, "next").select("doc_id", "text", "fingerprint", "after", "after_print")

    def finish(batches):
        for batch in batches:
            out = [_row(d, t, p, a, q) for d, t, p, a, q in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True)], _NAMES)

    return told.where(F.col("end").isNull()).select(*_NAMES).unionByName(tails.mapInArrow(finish, f"doc_id long, {FIELDS}"))

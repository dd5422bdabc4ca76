"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. With three differing bits at most, two of the three
segments differ in one bit at most each (pigeonhole). A segment, filled up to 23 bits, decodes to the index of the one
codeword of the perfect (23,12) Golay code within three bits; the codewords to which it and its one-bit neighbours
decode are its keys, six at most. If two segments differ in one bit at most, the index of either is a key of the other.
For each of the three pairs of segments a fingerprint gives probe rows (keys of the first, index of the second) and
base rows (index of the first, keys of the second): two fingerprints within one bit in both segments share such a row.

Rows of a key meet in one task, sorted; candidate pairs are verified on all 64 bits there, and only the links that
join what isn't joined yet leave the task, so a group of n near copies gives n - 1 links, not n * n. Keys with many
rows, told from a sample, are cut into blocks, and each pair of blocks is a group of its own: no group is larger than two
blocks, no pair is lost. Equal fingerprints are one row from the start.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, stash
from casegraph.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
SEED, SHINGLE, DISTANCE, BUCKET = 42, 3, 3, 4096
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """For each 23-bit word, the index (12 bits) of the codeword within three bits of it."""
    index = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, np.int64)
    for k in range(12):
        words ^= np.where(index >> k & 1, GENERATOR << k, 0)
    table = np.full(1 << 23, -1, np.int16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[words ^ sum(1 << b for b in bits)] = index
    return table


def segment_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, keys) of segments: keys [row, 1 + width] with repeats set to -1."""
    table = golay_table()
    keys = np.stack([table[segment], *(table[segment ^ (1 << b)] for b in range(width))], axis=1).astype(np.int64)
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return table[segment].astype(np.int64), keys


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of fingerprints (uint64): side 0 probes, side 1 is the base."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    coded = [segment_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    rows, keys, sides = [], [], []
    for k, (i, j) in enumerate(PAIRS):
        for side, (many, one, up, other) in enumerate(((i, j, 12, 0), (j, i, 0, 12))):
            row, col = np.nonzero(coded[many][1] >= 0)
            rows.append(row)
            keys.append((k << 24) | (coded[many][1][row, col] << up) | (coded[one][0][row] << other))
            sides.append(np.full(len(row), side, np.int8))
    return tuple(map(np.concatenate, (rows, keys, sides)))


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall(text.encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = [b" ".join(words)] if n == 1 else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([xxh64_intdigest(g, seed) for g in grams[at : at + 65536]], ">u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) of each row of `docs` (doc_id, text).

    Words are maximal runs of characters other than ASCII white space, A-Z lower-cased. Fewer words than a shingle
    give one shingle of all of them; null, empty and blank texts give 0. Repeated rows are kept; extra columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = [simhash(t or "", shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(np.array(prints, np.uint64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


#: The fingerprints that rows carry: one array of uint64 for each.
Prints = list[np.ndarray]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b (rows 0 to n-1) join what those before them haven't joined."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def _apart(prints: Prints, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows x and y differ, over all fingerprints that rows carry."""
    return sum(np.bitwise_count(p[x] ^ p[y]) for p in prints)


def group_links(side: np.ndarray, prints: Prints, nodes: np.ndarray, distance: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links between the nodes of one group: a spanning forest of the pairs within `distance` bits."""
    names, at = np.unique(nodes, return_inverse=True)
    probe, base = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = [], []
    for k in range(0, len(probe), step):
        part = probe[k : k + step]
        i, j = np.nonzero(_apart(prints, part[:, None], base[None, :]) <= distance)
        x, y = at[part[i]], at[base[j]]
        x, y = x[x != y], y[x != y]
        if len(x):
            some = _forest(x, y, len(names))
            left.append(x[some])
            right.append(y[some])
    if not left:
        return nodes[:0], nodes[:0]
    x, y = np.concatenate(left), np.concatenate(right)
    some = _forest(x, y, len(names))
    return names[x[some]], names[y[some]]


def sorted_links(group: np.ndarray, side: np.ndarray, prints: Prints, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal `group`; rows are sorted by (group, side)."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    probes = np.add.reduceat(side == 0, starts)
    bases = ends - starts - probes
    products = probes * bases
    small = (products > 0) & (ends - starts <= 64)
    # every probe row of the small groups against the base rows of its group, all at once
    per_row = np.repeat(np.where(small, bases, 0), probes)
    rows = np.flatnonzero(side == 0)
    left = np.repeat(rows, per_row)
    within = np.arange(len(left)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    right = np.repeat(np.repeat(starts + probes, probes), per_row) + within
    near = _apart(prints, left, right) <= distance
    a, b = [nodes[left[near]]], [nodes[right[near]]]
    for k in np.flatnonzero((products > 0) & ~small):
        own = slice(starts[k], ends[k])
        x, y = group_links(side[own], [p[own] for p in prints], nodes[own], distance)
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    apart = a != b
    a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
    both = np.unique(np.stack([a, b]), axis=1) if len(a) else np.stack([a, b])
    return both[0], both[1]


#: One node in so many is looked at to find keys that have to be cut into blocks.
HOT_SAMPLE = 16
#: Hot keys up to this number are broadcast (16 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 65536


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between nodes of `prints` (node, table, print, more) with a fingerprint of one table within `distance` bits.

    `more` is an array of further fingerprints, as many in each row; keys come from `print` alone, and the bits of
    all count. All pairs within three bits are found, and of those further apart the ones that share a key. Not all
    pairs are given, but links enough that two nodes are connected exactly if a chain of found pairs connects them. A
    node has one row for each table; keys with about `bucket` rows or more are cut into blocks. A group is named by a
    64-bit hash of its key and blocks: two groups that share a name only give more pairs to look at.
    """
    more = prints.select(F.size("more").alias("n")).first()
    extra = [f"more{k}" for k in range(more.n if more else 0)]
    wide = prints.select("node", "table", "print", *(F.col("more")[k].alias(c) for k, c in enumerate(extra)))

    def keyed(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, 8192):
                node, of, *got = (c[at : at + 8192] for c in columns)
                row, key, side = fuzzy_keys(got[0].view(np.uint64))
                key = key | (of.astype(np.int64)[row] << 26)
                taken = [pa.array(x[row]) for x in (*got, node)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), *taken], ["key", "side", "print", *extra, "node"])

    def keys_of(some: DataFrame) -> DataFrame:
        return some.mapInArrow(keyed, ", ".join(["key long, side byte, print long", *(f"{c} long" for c in extra), "node long"]))

    keys = keys_of(wide)
    sample = keys_of(wide.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(HOT_SAMPLE)) == 0))
    hot = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SAMPLE * 2 > bucket)
    hot, _ = stash(hot.select("key", F.ceil(F.col("n") * HOT_SAMPLE / bucket + 1).cast("int").alias("blocks")), "hot-keys")
    if hot.count() <= MOST_BROADCAST:
        hot = F.broadcast(hot)
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    # probe rows of block i meet base rows of block j in group (key, i, j)
    pairs = F.transform(others, lambda x: F.when(F.col("side") == 0, F.xxhash64("key", "own", x)).otherwise(F.xxhash64("key", x, "own")))
    kept = ("side", "print", *extra, "node")
    dealt = keys.join(hot, "key", "left").withColumn("own", own).select(F.explode(pairs).alias("group"), *kept)

    def meet(batches, least: int = 16384):
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < least:
                continue
            now = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero(now[0] != now[0][-1])
            cut = last[-1] + 1 if len(last) else 0
            held, n = [[x[cut:] for x in now]], len(now[0]) - cut
            if cut:
                yield from found([x[:cut] for x in now])
            least = max(16384, 2 * n)  # a group that goes on is looked at again when it has doubled
        if n:
            yield from found([np.concatenate(x) for x in zip(*held, strict=True)])

    def found(x: list[np.ndarray]):
        group, side, *got, node = x
        a, b = sorted_links(group, side, [p.view(np.uint64) for p in got], node, distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "group").sortWithinPartitions("group", "side").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of `distance` bits.

    One row for each row of `docs`; see fingerprints for null, empty and short texts. A component whose doc_ids are
    all null has a null component_id, else nulls don't count. Empty tables give an empty result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys find all pairs within three bits only")
    prints, _ = stash(fingerprints(docs, shingle, seed), "simhash")
    firsts, _ = stash(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-prints")
    each = firsts.select(F.col("print").alias("node"), F.lit(0).alias("table"), "print", F.array().cast("array<bigint>").alias("more"))
    roots = components(links(each, distance, bucket))
    rooted = firsts.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select("print", "component_id")
    return prints.join(member, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

"""Best-fit packing of tokenised documents into fixed-length sequences.

The instance is the histogram of piece lengths, which has `capacity` classes at most whatever the corpus holds, so
the packing itself is planned on the driver over classes and multiplicities:

1. Martello-Toth reduction: for each length, largest first, look for a set of three pieces at most that dominates
   every other feasible set with that piece; such a set is fixed as a sequence and its pieces leave the instance.
2. Best-fit decreasing over the remainder, many equal bins at a time.

The plan says which ranks of which length stand where; every piece finds its place by its rank within its length.
Ranks are counted within (length, salt), so a length that a third of all pieces share is still spread over tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, salts, stash

CAPACITY = 4096
END_ID = 1
#: Chunks kept by a worker's cache before it starts anew: about 100 MB.
CACHE_CHUNKS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Characters whose words the plain path below tells as the tokenizer does; other chunks go to the tokenizer.
_OTHER = re.compile("[^\x21-\x7e¡-įı-ſ]|<\\|")
_LETTER, _DIGIT = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class ChunkTokenizer:
    """Token ids of whole texts through a cache of white-space-separated chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.bytes_to_chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            shown = word.encode().decode("latin-1").translate(self.bytes_to_chars)
            got = self.words[word] = struct.pack(f"<{len(t := self.model.tokenize(shown))}I", *[x.id for x in t])
        return got

    def _chunk(self, chunk: str) -> bytes:
        got = self._ids(chunk) if _OTHER.search(chunk) else b"".join(map(self._word, _WORD.findall(chunk.lower())))
        self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _SEPARATORS.search(text):  # Python takes these for white space, the tokenizer does not
            return self._ids(text)
        if len(self.chunks) + len(self.words) > CACHE_CHUNKS:
            self.chunks.clear()
            self.words.clear()
        get, parts = self.chunks.get, text.split()
        out = [got if (got := get(x)) is not None else self._chunk(x) for x in parts]
        return b"".join(out)


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text): ids of the whole text, then `end_id`, cut where longer than `capacity`.

    Null text counts as empty (one piece that holds `end_id` alone); a null doc_id stays null; repeated rows give
    repeated pieces; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    end, step = struct.pack("<I", end_id), 4 * capacity

    def pieces(batches):
        encode = chunk_tokenizer(tokenizer_path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def _largest(count: np.ndarray, limit: int) -> int:
    there = np.flatnonzero(count[: max(0, limit) + 1])
    return int(there[-1]) if len(there) else 0


def _smallest(count: np.ndarray, n: int) -> list[int]:
    """The n smallest pieces, with their multiplicity."""
    out: list[int] = []
    for s in np.flatnonzero(count):
        out += [int(s)] * min(n - len(out), int(count[s]))
        if len(out) >= n:
            break
    return out


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int]:
    """Two pieces (a, b), a >= b, of the largest sum within `room`; the largest a among such pairs."""
    sizes = np.flatnonzero(count[: room + 1])[::-1]
    best, pair = 0, (0, 0)
    for a in sizes.tolist():
        if 2 * a < best:
            break
        count[a] -= 1
        b = _largest(count, min(a, room - a))
        count[a] += 1
        if b and a + b > best:
            best, pair = a + b, (a, b)
    return pair


def dominating_set(count: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set that holds a piece of length j and dominates all feasible sets that hold it, or None if none is proven.

    `count` is the histogram without that piece. The cases are Martello and Toth's: nothing fits beside it; one
    other piece at most fits, or the largest that fits fills the sequence; two at most fit, and either the largest
    alone is worth any pair, or a best pair takes the largest and nothing larger can replace its second.
    """
    room = capacity - j
    small = _smallest(count, 3)
    if not small or small[0] > room:
        return (j,)
    top = _largest(count, room)
    if j + top == capacity or len(small) < 2 or small[0] + small[1] > room:
        return j, top
    if len(small) < 3 or sum(small) > room:
        a, b = _best_pair(count, room)
        if top >= a + b:
            return j, top
        if a == top:
            larger = count.copy()
            larger[a] -= 1
            larger[: b + 1] = 0  # pieces other than a that are larger than b
            next_two = _smallest(larger, 2)
            # with another pair (p, q), p <= a holds; q > b would need two pieces larger than b that fit together
            both = ([a] if b < a else []) + next_two
            both.sort()
            if len(both) < 2 or both[0] + both[1] > room:
                return j, a, b
    return None


def reduce_instance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets until none is left; `count` becomes the remainder. Returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                count[j] -= 1
                found = dominating_set(count, j, capacity)
                count[j] += 1
                if not found:
                    break
                need = {s: found.count(s) for s in found}
                # the cases look at four pieces of a length at most: while more remain, the same set dominates again
                times = max(1, min((int(count[s]) - 4) // k for s, k in need.items()))
                for s, k in need.items():
                    count[s] -= k * times
                fixed.append((found, times))
                changed = True
    return fixed


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as ((length, times in it), ...), number of such sequences."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    done = [(tuple((s, 1) for s in found), n) for found, n in reduce_instance(count, capacity)]
    bins: dict[int, list[list]] = {}
    open_at = np.zeros(capacity + 1, bool)

    def put(residual: int, pattern: tuple, n: int) -> None:
        bins.setdefault(residual, []).append([pattern, n])
        open_at[residual] = True

    for s in np.flatnonzero(count)[::-1].tolist():
        left = int(count[s])
        while left:
            fits = np.flatnonzero(open_at[s:])
            if not len(fits):
                each = capacity // s
                full, rest = divmod(left, each)
                if full:
                    put(capacity - s * each, ((s, each),), full)
                if rest:
                    put(capacity - s * rest, ((s, rest),), 1)
                break
            r = s + int(fits[0])
            each = r // s
            entry = bins[r][-1]
            n, take = (min(entry[1], left // each), each) if left >= each else (1, left)
            entry[1] -= n
            if not entry[1]:
                bins[r].pop()
                open_at[r] = bool(bins[r])
            put(r - s * take, (*entry[0], (s, take)), n)
            left -= n * take
    return done + [(p, n) for entries in bins.values() for p, n in entries]


def plan_runs(plan: list, shift: int = 44) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: from rank `rank` of a length on, `times` pieces go into each next sequence."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in plan:
        at = 0
        for s, times in pattern:
            rows.append(((s << shift) | rank.get(s, 0), rank.get(s, 0), base, times, at))
            rank[s] = rank.get(s, 0) + n * times
            at += s * times
        base += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("key", "rank", "base", "times", "at"), columns, strict=True))


#: A plan over 4096 classes has a few runs for each class; beyond this it isn't broadcast.
MOST_RUNS = 1_000_000


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences: adds sequence_id and offset.

    Sequences hold `capacity` tokens at most and have no gaps. No piece is dropped, repeated rows are placed each;
    an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    n = salts(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts, _ = stash(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_runs(plan_packing(histogram, capacity))
    if len(runs["key"]) > MOST_RUNS:
        raise ValueError(f"a plan of {len(runs['key'])} runs is too large to broadcast")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    shared = spark.sparkContext.broadcast(runs)

    def place(batches):
        r = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = np.searchsorted(r["key"], (length << 44) | rank, side="right") - 1
            t = rank - r["rank"][run]
            sequence = r["base"][run] + t // r["times"][run]
            offset = r["at"][run] + t % r["times"][run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack `docs` (doc_id, text); see tokenize_pieces and pack."""
    pieces, _ = stash(tokenize_pieces(docs, tokenizer_path, capacity), "pack-pieces")
    return pack(pieces, capacity)

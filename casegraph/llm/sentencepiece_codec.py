"""SentencePiece encoding by suffix-array matching, and decoding.

The texts of a batch are cut into words (no piece has a space mark after another character, so none crosses a cut), new
words into units of letters or of other characters, if no piece of the model holds both. Distinct units that aren't known
yet are concatenated, and the concatenation is indexed by a suffix array. All pieces are looked up in it at once, by
binary search, one more character at a time, which gives each piece's range of occurrences. The occurrences are edges;
sorted by where they end, they are relaxed from the left: a place is reached by the one edge that ends there and agrees
with the edge that reached its beginning.

For a unigram model that would be the best sum of scores; the model here is a BPE model, whose merges go by score and
then from the left. For such models an encoding is right exactly if each of its pieces and each pair of neighbours
encode to themselves (a merge across a border would have happened within the pair already), so relaxing keeps, for each
place, the only piece that can end there. A pair encodes to itself if no two parts that stand at the border at the same
time have a union that is merged before either is merged into its own piece; the parts are found by undoing both pieces'
merges, the latest first. All pairs of a step are judged at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches

SPACE = "▁"
#: Words, and units, that a worker remembers before it starts anew, and characters of the longest remembered: some 80 MB each.
CACHE_WORDS, CACHE_LONGEST = 400_000, 256
#: Characters of new units that are indexed at a time.
INDEX_CHARS = 1 << 20
_END = 0x110000  # parts units in the index; no character
_WORD = re.compile(" *[^ ]+| +")
_UNIT = regex.compile(r" *\p{L}+| *[^\p{L} ]+| +")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Beginnings of suffixes, sorted by their first `depth` codes at least, by doubling from as many codes as fit a number."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    rank = np.cumsum(there)[codes]
    width = int(rank.max()).bit_length()
    key, h = rank.astype(np.int64), 1
    for k in range(1, min(62 // width, depth)):
        key <<= width
        key[: n - k] |= rank[k:]
        h += 1
    while True:
        order = np.argsort(key)
        if h >= depth:
            return order
        fresh = np.empty(n, bool)
        fresh[0] = False
        np.not_equal(key[order[1:]], key[order[:-1]], out=fresh[1:])
        step = np.cumsum(fresh)
        if step[-1] == n - 1:
            return order
        key = np.empty(n, np.int64)
        key[order] = step
        after = np.zeros(n, np.int64)
        after[: n - h] = key[h:] + 1
        key = key * (n + 2) + after
        h *= 2


class PairTable:
    """Number of the piece that two parts (codes below 2^21) make, by open hashing; -1 for none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray):
        self.bits = max(4, int(4 * len(piece)).bit_length())
        self.key, self.piece = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        code = (left << 21) | right
        at, rest = self._slot(code), np.arange(len(code))
        while len(rest):  # of those that want a free slot the last one gets it
            free = self.key[at[rest]] < 0
            self.key[at[rest[free]]] = code[rest[free]]
            placed = self.key[at[rest]] == code[rest]
            self.piece[at[rest[placed]]] = piece[rest[placed]]
            rest = rest[~placed]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << 21) | right
        at = self._slot(code)
        got = self.key[at]
        out = np.where(got == code, self.piece[at], -1)
        rest = np.flatnonzero((got != code) & (got >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[rest]]
            out[rest] = np.where(got == code[rest], self.piece[at[rest]], -1)
            rest = rest[(got != code[rest]) & (got >= 0)]
        return out


class Codec:
    """Encoder and decoder of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        self.unknown = sp.unk_id()
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) for k in range(n)]
        is_byte = [sp.is_byte(k) for k in range(n)]
        self.bytes = {int(_BYTE.fullmatch(self.pieces[k])[1], 16): k for k in range(n) if is_byte[k]}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.silent = {k for k in range(n) if sp.is_control(k)}
        self.score = {self.pieces[k]: sp.get_score(k) for k in range(n) if not special[k] and not is_byte[k]}
        self.id = {self.pieces[k]: k for k in range(n) if self.pieces[k] in self.score}
        self.depth = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space mark after another character")
        # probes of the model's normalizer: only these forms are known here
        ids = sp.encode("a  b")
        if sp.decode(ids) != "a  b" or self.pieces[ids[0]][0] != SPACE:
            raise ValueError("the model doesn't keep spaces or doesn't begin texts with a space mark")
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.unit = _UNIT if all(_UNIT.fullmatch(p.replace(SPACE, " ")) for p in self.score) else _WORD
        self._levels()
        self._splits()
        self._tables()

    def _levels(self) -> None:
        """All beginnings of pieces by length: character, number of the beginning that is one shorter, piece or -1."""
        known: dict[str, int] = {}
        self.levels = []
        for length in range(1, self.depth + 1):
            level = sorted({p[:length] for p in self.score if len(p) >= length})
            shorter, known = known, {s: k for k, s in enumerate(level)}
            parents = np.array([shorter.get(s[:-1], 0) for s in level], np.int64)
            self.levels.append((np.array([ord(s[-1]) for s in level], np.int64), parents, np.array([self.id.get(s, -1) for s in level], np.int64)))

    def _splits(self) -> None:
        """Each piece's last merge, its rank among merges, and whether it encodes to itself at all."""
        n = len(self.pieces)
        by_score = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        # merging pieces of equal score goes by place as well: pieces that may hold such parts are judged by merging them
        same = Counter(self.score[p] for p in by_score)
        tied = {p[k : k + 2] for p in by_score if same[self.score[p]] > 1 for k in range(len(p) - 1)}
        begins, ends = {x[1] for x in tied}, {x[0] for x in tied}
        #: Whether a piece has to be judged by merging, or a border after or before it; the last is for other characters.
        self.odd, self.odd_end, self.odd_begin = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        for p, k in self.id.items():
            self.odd_end[k], self.odd_begin[k] = p[-1] in ends, p[0] in begins
        for x in tied:
            self.odd[[k for p, k in self.id.items() if x in p]] = True
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[[self.id[p] for p in by_score]] = np.arange(len(by_score))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.stable = np.zeros(n, bool)
        self.stable[[k for p, k in self.id.items() if len(p) == 1]] = True
        number = self.id.get
        made = [(i, j, self.id[p], len(p)) for p in by_score for k in range(1, len(p)) if (i := number(p[:k])) is not None and (j := number(p[k:])) is not None]
        a, b, whole, length = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 4
        self.made = PairTable(a, b, whole)
        for size in np.unique(length).tolist():
            here = length == size
            self.odd[whole[here & (self.odd[a] | self.odd[b])]] = True
            for k in np.unique(whole[here & self.odd[whole]]).tolist():
                self.stable[k] = self.merge(self.pieces[k]) == [self.pieces[k]]
            at = np.flatnonzero(here & ~self.odd[whole] & self.stable[a] & self.stable[b])
            at = at[self._apart(a[at], b[at], whole[at])]
            self.left[whole[at]], self.right[whole[at]], self.stable[whole[at]] = a[at], b[at], True
            # merged before a part of it: the walk back in time doesn't hold
            self.odd[whole[at[self.rank[whole[at]] <= np.maximum(self.rank[a[at]], self.rank[b[at]])]]] = True

    def _apart(self, left: np.ndarray, right: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of pieces is there, side by side, at some time of merging; pieces that make `but` are merged later."""
        n = len(self.pieces)
        out = np.ones(len(left), bool)
        at = np.arange(len(left))
        x, y = left, right
        limit_x = limit_y = np.full(len(left), 1 << 40, np.int64)
        while len(at):
            made = self.made.find(x, y)
            if but is not None:
                made = np.where(made == but, -1, made)
                but = None
            rank = self.rank[made]  # -1 is the last place, which has no rank
            crossed = (made >= 0) & (rank < limit_x) & (rank <= limit_y)
            out[at[crossed]] = False
            rank_x, rank_y = self.rank[np.minimum(x, n)], self.rank[np.minimum(y, n)]
            live = np.flatnonzero(~crossed & ((rank_x >= 0) | (rank_y >= 0)))
            at, x, y, limit_x, limit_y, rank_x, rank_y = (v[live] for v in (at, x, y, limit_x, limit_y, rank_x, rank_y))
            later = rank_x > rank_y  # of equal pieces the right one is the later
            limit_x, limit_y = np.where(later, rank_x, limit_x), np.where(later, limit_y, rank_y)
            x, y = np.where(later, self.right[np.minimum(x, n)], x), np.where(later, y, self.left[np.minimum(y, n)])
        return out

    def _tables(self) -> None:
        """What each id decodes to, as UTF-8 or a single byte."""
        told = [b"" if k in self.silent else " ⁇ ".encode() if k == self.unknown else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        for k, b in self.byte_of.items():
            told[k] = bytes([b])
        self.told = pa.array(told, pa.binary())

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text: always the pair whose union has the highest score, the first of such."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes to itself."""
        codes, at = np.unique((left << 21) | right, return_inverse=True)
        left, right, n = codes >> 21, codes & 0x1FFFFF, len(self.pieces)
        x, y = np.minimum(left, n), np.minimum(right, n)
        odd = self.odd[x] | self.odd[y] | (self.odd_end[x] & self.odd_begin[y])
        out = np.empty(len(codes), bool)
        out[~odd] = self._apart(left[~odd], right[~odd])
        out[odd] = [self._tried(*pair) for pair in zip(left[odd].tolist(), right[odd].tolist(), strict=True)]
        return out[at]

    def _tried(self, left: int, right: int) -> bool:
        """Whether a pair encodes to itself, by merging it."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            a, b = (self.pieces[k] if k < len(self.pieces) else chr(k - len(self.pieces)) for k in (left, right))
            got = self.pairs[left, right] = self.merge(a + b) == [a, b]
        return got

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, piece) of all occurrences of pieces in `codes`, by suffix array."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.full(self.depth + 1, -1, np.int64)])
        lo, hi = np.zeros(1, np.int64), np.full(1, len(codes), np.int64)
        begins, lengths, ids = [], [], []
        for depth, (chars, parents, piece) in enumerate(self.levels):
            top_lo, top_hi = (lo[parents], hi[parents]) if depth else (np.zeros(len(chars), np.int64), np.full(len(chars), len(codes)))
            live = np.flatnonzero(top_lo < top_hi)
            ends = []
            for strict in (False, True):
                a, b = top_lo[live].copy(), top_hi[live].copy()
                want = chars[live]
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    middle = (a + b) >> 1
                    got = padded[order[np.minimum(middle, len(codes) - 1)] + depth]
                    right = open_ & ((got <= want) if strict else (got < want))
                    a = np.where(right, middle + 1, a)
                    b = np.where(open_ & ~right, middle, b)
                ends.append(a)
            lo, hi = np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
            lo[live], hi[live] = ends
            found = np.flatnonzero((piece >= 0) & (lo < hi))
            found = found[self.stable[piece[found]]]
            if len(found):
                many = hi[found] - lo[found]
                begins.append(order[np.repeat(hi[found] - np.cumsum(many), many) + np.arange(many.sum())])
                lengths.append(np.full(many.sum(), depth + 1))
                ids.append(np.repeat(piece[found], many))
            if not len(live):
                break
        if not begins:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(begins), np.concatenate(lengths), np.concatenate(ids)

    def learn(self, units: list[str]) -> None:
        """Encode units and remember them."""
        sizes = np.array([len(w) for w in units], np.int64)
        joined = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(units)
        first = np.cumsum(sizes + 1) - sizes - 1
        codes = np.full(int((sizes + 1).sum()), _END, np.int64)
        codes[np.arange(len(joined)) + np.repeat(np.arange(n), sizes)] = joined
        begin, length, piece = self.edges(codes)
        single = np.zeros(len(codes), bool)
        single[begin[length == 1]] = True
        other = np.flatnonzero(~single & (codes != _END))  # characters that are no piece
        begin = np.concatenate([begin, other])
        length = np.concatenate([length, np.ones(len(other), np.int64)])
        piece = np.concatenate([piece, len(self.pieces) + codes[other]])
        ends = begin - np.repeat(first, sizes + 1)[begin] + length
        order = np.argsort(ends)
        begin, piece, length, ends = begin[order], piece[order], length[order], ends[order]
        last = np.full(len(codes) + 1, -1, np.int64)  # the piece that ends before a place
        from_ = np.zeros(len(codes) + 1, np.int64)
        steps = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True]) if len(ends) else np.zeros(1, int)
        starts = np.zeros(len(codes) + 1, bool)
        starts[first] = True
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            here, p = begin[a:b], piece[a:b]
            before = last[here]
            keep = starts[here]
            rest = np.flatnonzero(~keep & (before >= 0))
            keep[rest] = self._agree(before[rest], p[rest])
            at = np.flatnonzero(keep)
            to = here[at] + length[a:b][at]
            last[to], from_[to] = p[at], here[at]
        # back from the ends of all units at once
        owner, at, owners, found = np.arange(n), first + sizes, [], []
        while len(owner):
            got = last[at]
            if (got < 0).any():
                raise AssertionError(f"no encoding of {units[int(owner[(got < 0).argmax()])]!r}")
            owners.append(owner)
            found.append(got)
            at = from_[at]
            live = at > first[owner]
            owner, at = owner[live], at[live]
        owner, got = np.concatenate(owners)[::-1], np.concatenate(found)[::-1]
        order = np.argsort(owner, kind="stable")
        owner, got = owner[order], got[order]
        known = len(self.pieces)
        if (got >= known).any():
            owner, got = self._fallback(owner, got)
        raw, cuts = got.astype("<u4").tobytes(), (4 * np.searchsorted(owner, np.arange(n + 1))).tolist()
        self.units.update((u, raw[a:b]) for u, a, b in zip(units, cuts, cuts[1:], strict=False))

    def _fallback(self, owner: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of characters that are no piece: their bytes, or one unknown for each run of them."""
        known = len(self.pieces)
        if not self.bytes:
            strange = got >= known
            keep = ~strange | np.r_[True, ~strange[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
            return owner[keep], np.where(strange, self.unknown, got)[keep]
        chars, at = np.unique(got[got >= known] - known, return_inverse=True)
        spelt = [[self.bytes[b] for b in chr(c).encode("utf-8", "replace")] for c in chars.tolist()]
        width = np.ones(len(got), np.int64)
        width[got >= known] = np.array([len(x) for x in spelt])[at]
        out = np.repeat(got, width)
        inner = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        table = np.array([x + [0] * (4 - len(x)) for x in spelt])
        strange = np.flatnonzero(out >= known)
        out[strange] = table[np.repeat(at, width[got >= known]), inner[strange]]
        return np.repeat(owner, width), out

    def _cut(self, text: str) -> list[str]:
        """Words of a text, each with the spaces before it."""
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        return _WORD.findall(" " + text) if "" in words else [" " + w for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._cut(t) if t else [] for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(cut):  # texts whose new words fill an index, one text at least
            for kept in (self.words, self.units):
                if len(kept) > CACHE_WORDS:
                    kept.clear()
            new: set[str] = set()
            chars, to = 0, at
            while to < len(cut) and (to == at or chars < INDEX_CHARS):
                fresh = set(cut[to]).difference(self.words)
                fresh.difference_update(new)
                new |= fresh
                chars += sum(map(len, fresh))
                to += 1
            if new:
                parts = [self.unit.findall(w) for w in new]
                units = sorted({u for x in parts for u in x if u not in self.units})
                size, some = 0, []
                for u in units:  # a long text alone can fill several indexes
                    some.append(u)
                    size += len(u)
                    if size >= INDEX_CHARS:
                        self.learn(some)
                        size, some = 0, []
                if some:
                    self.learn(some)
                known = self.units.__getitem__
                self.words.update((w, b"".join(map(known, x))) for w, x in zip(new, parts, strict=True))
            get = self.words.__getitem__
            out += [b"".join(map(get, x)) for x in cut[at:to]]
            for kept in (self.words, self.units):
                for w in [w for w in new if len(w) > CACHE_LONGEST]:
                    kept.pop(w, None)
            at = to
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids: byte pieces in a row are UTF-8, the space mark at the beginning is dropped.

        A null list gives a null text, null elements are left out.
        """
        ids = ids.cast(pa.large_list(pa.int32()))
        bad = pc.or_(pc.less(ids.values, 0), pc.greater_equal(ids.values, len(self.pieces)))
        if pc.any(bad).as_py():
            raise ValueError("an id is no piece of the model")
        if pc.any(pc.equal(ids.values, self.unknown)).as_py():
            return pa.array([None if x is None else self._decode_slowly([k for k in x if k is not None]) for x in ids.to_pylist()], pa.string())
        told = pc.fill_null(pc.take(self.told.cast(pa.large_binary()), ids.values), b"")
        whole = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, told, mask=ids.is_null() if ids.null_count else None), pa.scalar(b"", pa.large_binary()))
        try:
            texts = whole.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
        return pc.replace_substring_regex(texts, r"\A ", "").cast(pa.string())

    def _decode_slowly(self, ids: list[int]) -> str:
        """The text of ids with unknown ones; the space before the sign of these isn't dropped."""
        told = [k for k in ids if k not in self.silent]
        text = b"".join(self.told[k].as_py() for k in told).decode("utf-8", "replace")
        return text[1:] if told and told[0] != self.unknown and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` of `docs`, ids array<int> and ids_crc32 long (of the ids as little-endian 32-bit numbers).

    Null and empty texts have no ids. Whole texts are encoded, whatever their length; repeated rows are encoded each;
    empty tables stay empty.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])

    def run(batches):
        for batch in batches:
            got = codec(model_path).encode([t or "" for t in batch.column(len(keep)).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, pa.array([zlib.crc32(x) for x in got], pa.int64())], [*keep, "ids", "ids_crc32"])

    return kept.mapInArrow(run, f"{fields}, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns `keep` of `encoded` and text: the decoded ids. Null ids give a null text, null elements are left out."""
    bounded_batches(encoded.sparkSession)
    kept = encoded.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], codec(model_path).decode(batch.column(len(keep)))], [*keep, "text"])

    return kept.mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32, exact: each text encoded and decoded again.

    `exact` says whether the decoded text is the text (it isn't where a text holds the space mark itself). A null text
    counts as empty.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("sha", F.sha2("text", 256))
    coded = encode(named, model_path, ("doc_id", "n_chars", "sha"))
    coded = coded.withColumn("n_tokens", F.size("ids").cast("bigint"))
    back = decode(coded, model_path, ("doc_id", "n_chars", "n_tokens", "ids_crc32", "sha"))
    return back.select("doc_id", "n_chars", "n_tokens", "ids_crc32", (F.sha2("text", 256) == F.col("sha")).alias("exact"))

"""Which records of a pool are one person: components of their match graph, told by blocking.

Records that agree in name, birth and number can't be told apart, so a pool is as large as it has different ones. Pairs
aren't tried: records meet over equal numbers, over neighbouring births in order, and over names of which one holds all
the words of the other, which are looked up by the rarest word. All three join more than two records at once.
"""

from __future__ import annotations

import difflib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from datetime import date
from functools import reduce

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DateType, IntegerType, StringType, StructType

#: How records of a pool may be held together: by enough of three signals; by these, or by name where a birth is missing;
#: by name.
STRICT, LOOSE, NAMED = "strict", "loose", "named"


#: Different records of a pool up to which its pairs are tried.
FEW = 4


class Groups:
    """Records put together; `of` is the record that stands for a group."""

    def __init__(self, n: int):
        self._up = list(range(n))

    def of(self, x: int) -> int:
        while self._up[x] != x:
            self._up[x] = x = self._up[self._up[x]]
        return x

    def join(self, records: Iterable[int]) -> None:
        first = None
        for x in records:
            root = self.of(x)
            first = root if first is None else first
            self._up[root] = first


class NameIndex:
    """Names as sets of words: which ones hold all words of a name, and which have all theirs in it."""

    def __init__(self, names: Iterable[frozenset[str]]):
        self.names = set(names)
        self._holders: dict[str, list[frozenset[str]]] = defaultdict(list)
        for name in self.names:
            for word in name:
                self._holders[word].append(name)
        self._by_rarest: dict[str, list[frozenset[str]]] = defaultdict(list)
        for name in self.names:
            self._by_rarest[self._rarest(name)].append(name)

    def _rarest(self, name: frozenset[str]) -> str:
        return min(name, key=lambda w: (len(self._holders.get(w, ())), w))

    def longer(self, name: frozenset[str]) -> Iterator[frozenset[str]]:
        """Names with all words of `name` and more."""
        return (x for x in self._holders.get(self._rarest(name), ()) if name < x)

    def fits(self, name: frozenset[str]) -> bool:
        """Whether some name has all words of `name`, or all of its own among them."""
        if name in self.names or next(self.longer(name), None) is not None:
            return True
        return any(x < name for word in name for x in self._by_rarest.get(word, ()))


def whole_years(earlier: date, later: date) -> int:
    return later.year - earlier.year - ((later.month, later.day) < (earlier.month, earlier.day))


class Pool:
    """A pool's different records (name, birth, number); `births` and the like list them."""

    def __init__(self, records: list[tuple[str, date | None, str]], tolerance: int):
        self.counts = Counter(records)
        self.records = list(self.counts)
        self.tolerance = tolerance
        self.words = [frozenset(name.split(" ")) if name else frozenset() for name, _, _ in self.records]

    def by_number(self) -> list[list[int]]:
        out: dict[str, list[int]] = defaultdict(list)
        for k, (_, _, number) in enumerate(self.records):
            if number:
                out[number].append(k)
        return list(out.values())

    def by_birth(self, some: Iterable[int]) -> Iterator[list[int]]:
        """Runs of records whose births follow each other within the tolerance: what connects them all."""
        dated = sorted((k for k in some if self.records[k][1]), key=lambda k: self.records[k][1])
        run: list[int] = []
        for k in dated:
            if run and whole_years(self.records[run[-1]][1], self.records[k][1]) > self.tolerance:
                yield run
                run = []
            run.append(k)
        if run:
            yield run

    def by_name(self, some: Iterable[int]) -> Iterator[list[int]]:
        """Records of each name, and with those of each longer one, in turn: all in a list match each other."""
        own: dict[frozenset[str], list[int]] = defaultdict(list)
        for k in some:
            if self.words[k]:
                own[self.words[k]].append(k)
        index = NameIndex(own)
        for name, records in own.items():
            yield records
            for other in index.longer(name):
                yield records + own[other]

    def agreeing(self, least: int) -> Iterator[list[int]]:
        """Lists of records of which each agrees with the next in `least` of name, birth and number."""
        every = range(len(self.records))
        numbers = self.by_number()
        if least == 1:
            yield from numbers
            yield from self.by_birth(every)
            yield from self.by_name(every)
        elif least == 2:
            for same in numbers:
                yield from self.by_birth(same)
                yield from self.by_name(same)
            for matching in self.by_name(every):
                yield from self.by_birth(matching)
        elif least == 3:
            for same in numbers:
                for matching in self.by_name(same):
                    yield from self.by_birth(matching)

    def undated(self) -> Iterator[list[int]]:
        """Lists of records that match by name, and of which the first has no birth."""
        for matching in self.by_name(range(len(self.records))):
            bare = [k for k in matching if not self.records[k][1]]
            if bare:
                yield bare[:1] + matching

    def _repeated(self, k: int, gate: str, least: int) -> bool:
        """Whether two records like this one are held together by themselves."""
        name, birth, number = self.records[k]
        enough = bool(name) + bool(birth) + bool(number) >= least
        return bool(name) if gate == NAMED else enough or gate == LOOSE and bool(name) and not birth

    def _held(self, x: int, y: int, gate: str, least: int) -> bool:
        """Whether two records are held together."""
        a, b = self.words[x], self.words[y]
        named = bool(a and b) and (a <= b or b <= a)
        if gate == NAMED:
            return named
        (_, born, number), (_, other, its) = self.records[x], self.records[y]
        near = bool(born and other) and whole_years(min(born, other), max(born, other)) <= self.tolerance
        enough = 1 <= least <= 3 and named + near + bool(number and number == its) >= least
        return enough or gate == LOOSE and named and not (born and other)

    def persons(self, gate: str, least: int) -> int:
        """Number of components."""
        n = len(self.records)
        groups = Groups(n)
        if n <= FEW:
            for x in range(n):
                for y in range(x):
                    if self._held(x, y, gate, least):
                        groups.join((x, y))
            return self._components(groups, gate, least)
        lists = [self.by_name(range(len(self.records)))] if gate == NAMED else [self.agreeing(least)]
        for records in (x for some in (*lists, *([self.undated()] if gate == LOOSE else [])) for x in some):
            groups.join(records)
        return self._components(groups, gate, least)

    def _components(self, groups: Groups, gate: str, least: int) -> int:
        members = Counter(groups.of(k) for k in range(len(self.records)))
        alone = (k for k, n in self.counts.items() if n > 1)
        place = {r: k for k, r in enumerate(self.records)}
        extra = sum(self.counts[r] - 1 for r in alone if members[groups.of(place[r])] == 1 and not self._repeated(place[r], gate, least))
        return len(members) + extra


class Records:
    """The records of a batch of pools, column by column."""

    def __init__(self, pools: pa.Array):
        self.ends = pools.offsets.to_pylist()
        kind, columns = pools.type.value_type, pools.values.flatten()
        self.columns = {kind.field(k).name: c for k, c in enumerate(columns)}
        self._lists = {n: self.columns[n].to_pylist() for n in ("doc", "name", "number", "nation", "born", "sex", "place", "fname", "fnum", "fnac")}

    def first(self, column: str, a: int, b: int) -> int | None:
        """The first record that has a value, empty texts being none."""
        return next((k for k in range(a, b) if self._lists[column][k]), None)

    def values(self, column: str, a: int, b: int, when: str | None = None) -> list:
        there = self._lists[when or column]
        return [self._lists[column][k] for k in range(a, b) if there[k]]

    def pool(self, a: int, b: int, tolerance: int) -> Pool:
        name, birth, number = (self._lists[c] for c in ("fname", "born", "fnum"))
        return Pool([(name[k], birth[k], number[k]) for k in range(a, b)], tolerance)


def unlike(names: list[str]) -> bool:
    """Whether two of some folded names don't match. Sets of words that all match pairwise are a chain, each within the
    next; in order of size it is enough to look at neighbours."""
    if len(names) > 1 and "" in names:
        return True
    chain = sorted({frozenset(n.split(" ")) for n in names}, key=len)
    return any(not a <= b for a, b in zip(chain, chain[1:], strict=False))


# The flags of a role.
CONFLICTS = ("NOMBRE_INCONSISTENTE", "FECHA_CONFLICTO", "ID_INCONSISTENTE", "NACIONALIDAD_INCONSISTENTE")
WEAK, AMBIGUOUS = "GENERACION_INFERIDA_BAJA_CONFIANZA", "NOMBRE_AMBIGUO"
#: Attributes of a person, and which record's value counts: the first with a value of the attribute named.
PERSON = {"name": "name", "fname": "name", "words": "name", "born": "born", "place": "place", "number": "number", "fnum": "number", "nation": "nation", "sex": "sex"}
_KINDS = {"words": ArrayType(StringType()), "born": DateType()}
ROLE = (
    StructType().add("person", reduce(lambda s, f: s.add(f, _KINDS.get(f, StringType())), PERSON, StructType())).add("rejected", BooleanType()).add("ambiguous", BooleanType())
    .add("flags", ArrayType(StringType())).add("documents", ArrayType(StringType())).add("persons", IntegerType())
)


def roles(least: int, tolerance: int):
    """A column function: the role of a pool of records without blank ones (see operators.lineage.ROLE).

    Where the second column is true, records are one person by signals, with a flag if only the weaker ones hold them
    together, else by name. A pool of several persons is ambiguous and names none of them.
    """

    @arrow_udf(ROLE)
    def resolve(pools: pa.Array, by_signals: pa.Array) -> pa.Array:
        records = Records(pools)
        firsts: dict[str, list[int | None]] = {c: [] for c in set(PERSON.values())}
        flags, docs, counts = [], [], []
        for a, b, signals in zip(records.ends, records.ends[1:], by_signals.to_pylist(), strict=False):
            pool = records.pool(a, b, tolerance) if b - a > 1 else None
            n = pool.persons(LOOSE if signals else NAMED, least) if pool else b - a
            if n == 1:
                several = (unlike(records.values("fname", a, b, "name")), *(len(set(records.values(c, a, b, w))) > 1 for c, w in (("born", "born"), ("fnum", "number"), ("fnac", "nation"))))
                raised = [f for f, bad in zip(CONFLICTS, several, strict=True) if bad]
                flags.append(raised + [WEAK] * bool(pool and signals and pool.persons(STRICT, least) > 1))
            else:
                flags.append([AMBIGUOUS] * (n > 1))
            docs.append(list(dict.fromkeys(records.values("doc", a, b))) if n == 1 else [])
            counts.append(n)
            for c, told in firsts.items():
                told.append(records.first(c, a, b) if n == 1 else None)
        at = {c: pa.array(told, pa.int64()) for c, told in firsts.items()}
        nobody = pa.array([n != 1 for n in counts])
        person = pa.StructArray.from_arrays([records.columns[f].take(at[c]) for f, c in PERSON.items()], list(PERSON), mask=nobody)
        many, texts = pa.array([n > 1 for n in counts]), pa.list_(pa.string())
        parts = {"person": person, "rejected": pa.array([False] * len(counts)), "ambiguous": many, "flags": pa.array(flags, texts), "documents": pa.array(docs, texts), "persons": pa.array(counts, pa.int32())}
        return pa.StructArray.from_arrays(list(parts.values()), list(parts))

    return resolve


def nearest(name: str, others: Iterable[str]) -> float:
    """The greatest similarity of a name to others, 0 without any; what can't be greater isn't worked out."""
    best = 0.0
    for other in others:
        match = difflib.SequenceMatcher(None, name, other)
        if name and other and match.real_quick_ratio() > best and match.quick_ratio() > best:
            best = max(best, match.ratio())
    return best


@arrow_udf(ArrayType(IntegerType()))
def parent_slots(subjects: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """For each subject's name the parent it is, 1 or 2 by the names of either, the more similar where both fit; 0 if
    neither fits or both are as similar."""
    out = []
    for names, *slots in zip(subjects.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True):
        if not names:
            out.append([])
            continue
        known = [list(dict.fromkeys(s or ())) for s in slots]
        indexes = [NameIndex(frozenset(n.split(" ")) for n in s if n) for s in known]
        told: dict[str, int] = {"": 0}
        for name in names:
            if name not in told:
                fits = [index.fits(frozenset(name.split(" "))) for index in indexes]
                near = [nearest(name, s) for s in known] if all(fits) else [float(f) for f in fits]
                told[name] = 0 if near[0] == near[1] else 1 if near[0] > near[1] else 2
        out.append([told[n] for n in names])
    return pa.array(out, pa.list_(pa.int32()))

"""Vectors as whole numbers, exact distances between them, and exact sums over all of them.

A round of an iterated operator is one pass over a written table: it writes each vector with its new state and, beside
them, what its task's vectors add up to. The sums are cut into limbs (base 2^40), so that Spark adds them as longs
without loss; what reaches the driver is as large as the model, not as the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 40
#: Place of a cell's number of vectors among its sums, and components handled at once.
COUNT, BLOCK_CELLS = -1, 1 << 21
#: Columns of the rows that carry sums, null in rows of vectors.
SUMS = "cell int, place int, limb int, amount long"
LONGS = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    """Whether a vector (array of doubles) is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as longs; what is beyond a long is held at its ends."""
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))


def kind(most: int) -> type:
    """Numbers that hold whole numbers up to `most` exactly."""
    return np.int64 if most < 1 << 62 else object


def greatest(*arrays: np.ndarray) -> int:
    return max([1, *(max(abs(int(x.min())), abs(int(x.max()))) for x in arrays if x.size)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, exact, as longs where they fit and else as Python's integers."""
    bound = a.shape[1] * (2 * greatest(a, b)) ** 2
    if bound < 1 << 53:  # every product and partial sum is exact
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    x, y = a.astype(kind(bound)), b.astype(kind(bound))
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1) if len(y) else np.zeros((len(a), 0), np.int64)


def clamped(values: Iterable) -> list[int]:
    """Whole numbers held at a long's ends."""
    return [max(LONGS[0], min(LONGS[1], int(v))) for v in values]


class Sums:
    """Number and componentwise sum of the vectors of each cell, exact."""

    def __init__(self, cells: int, width: int):
        self.counts = np.zeros(cells, np.int64)
        self.totals = np.zeros((cells, width), object)

    def add(self, cells: np.ndarray, x: np.ndarray) -> None:
        n = len(self.counts)
        self.counts += np.bincount(cells, minlength=n)
        if len(x) * greatest(x) < 1 << 53:
            added = [np.bincount(cells, weights=column, minlength=n).astype(np.int64) for column in x.T]
            for k, column in enumerate(added):
                self.totals[:, k] += column.astype(object)
        else:
            np.add.at(self.totals, cells, x.astype(object))

    def rows(self) -> list[tuple[int, int, int, int]]:
        out = []
        for cell in np.flatnonzero(self.counts).tolist():
            out.append((cell, COUNT, 0, int(self.counts[cell])))
            for place, total in enumerate(self.totals[cell].tolist()):
                sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
                while rest:
                    out.append((cell, place, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks of BLOCK_CELLS components or a little more."""
    held, cells = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cells += len(batch.column(batch.schema.get_field_index("x")).values)
        if cells >= BLOCK_CELLS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, cells = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(block: pa.Table, width: int) -> np.ndarray:
    """The vectors of a block, all of one width."""
    column = block.column("x").combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(block.num_rows, width)


def one_pass(state: DataFrame, schema: str, step: Callable[[pa.Table, Sums], dict[str, pa.Array]], cells: int, width: int) -> DataFrame:
    """`step` over all blocks of `state`: its columns (those of `schema` that it doesn't name stay), then the sums of
    each task, of `cells` cells of `width` components."""
    names = [f.split()[0] for f in schema.split(",")]
    rest = [f.split()[0] for f in SUMS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, like = Sums(cells, width), None
        for block in blocks(batches):
            new = step(block, sums)
            columns = {n: new[n] if n in new else block.column(n).combine_chunks() for n in names}
            like = like or {n: c.type for n, c in columns.items()}
            n = block.num_rows
            columns |= {r: pa.nulls(n, pa.int64() if r == "amount" else pa.int32()) for r in rest}
            yield from pa.table(columns).to_batches(max_chunksize=65536)
        added = sums.rows()
        if added:
            columns = {n: pa.nulls(len(added), t) for n, t in like.items()}
            cell = zip(*added, strict=True)
            columns |= {r: pa.array(c, pa.int64() if r == "amount" else pa.int32()) for r, c in zip(rest, cell, strict=True)}
            yield from pa.table(columns).to_batches()

    return state.select(*names).mapInArrow(run, f"{schema}, {SUMS}")


def gathered(written: DataFrame) -> dict[tuple[int, int], int]:
    """(cell, place) -> sum over all tasks; a cell's number of vectors is at place COUNT."""
    limbs = written.where(F.col("cell").isNotNull()).groupBy("cell", "place", "limb").agg(F.sum("amount").alias("amount")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in limbs:
        out[r["cell"], r["place"]] = out.get((r["cell"], r["place"]), 0) + (int(r["amount"]) << (LIMB * r["limb"]))
    return out


def moved(centres: list[list[int]], sums: dict[tuple[int, int], int]) -> list[list[int]]:
    """Each centre as the componentwise floor of its vectors' mean; one without vectors stays."""
    out = []
    for cell, centre in enumerate(centres):
        n = sums.get((cell, COUNT), 0)
        out.append([sums.get((cell, k), 0) // n for k in range(len(centre))] if n else list(centre))
    return out


def long_sum(column: str) -> Column:
    """Sum of longs, held at a long's ends."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.greatest(F.least(total, F.lit(LONGS[1]).cast("decimal(38,0)")), F.lit(LONGS[0]).cast("decimal(38,0)")).cast("long")

"""Document quality by co-training of two views.

View `content` sees the text: hashed character pairs of several kinds and measures of the writing. View `metadata` sees
what a crawl knows about the page besides its words: source, language, length, and the shape of its lines. Each view's
logistic regression is fitted on the labelled rows; then, for some rounds, each view scores all unlabelled rows
and hands the few it is surest of, with its own verdict as label, to the other view, if verdicts as sure as these are right
on labelled rows kept apart: a weak view's errors, handed over, would spoil a better one. The views are calibrated by Platt
scaling on labelled rows kept apart, and combined by the weights that fit those rows best; all documents are scored.

Models are fitted on the driver from bounded sets of feature vectors, never of texts; every round and the final scoring
cover every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import bounded_batches, salts

#: Rows, in expectation, of the labelled sample (a third of it for calibration).
LABELLED_ROWS = 4000
#: Rounds, and rows that a view hands over in one at most, the surest of all unlabelled rows.
ROUNDS, HANDED = 2, 400
#: How often a view's verdicts of some confidence have to be right, on labelled rows kept apart, for it to hand them over.
SURE = 0.98
PAIR_BUCKETS, SOURCE_BUCKETS = 256, 64
#: Characters of a class are told apart only by the class.
CLASSES = 12


def _class_table() -> np.ndarray:
    """Class of each byte: letters by case, digits, kinds of marks, space, line end, and bytes of other characters."""
    kind = np.full(256, 11, np.uint8)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    for k, marks in enumerate((b" \t", b"\n\r", b".,", b"!?", b"'\"-:;()", b"#$%&*@+=", b"|<>{}[]\\/^_~`")):
        kind[list(marks)] = 3 + k
    kind[128:] = 10
    return kind


_CLASS = _class_table()


def _shape(text: str) -> np.ndarray:
    """Shape of the lines: number, lengths, short lines, repeated lines."""
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(lines))
    lengths = np.array([len(x) for x in lines] or [0])
    return np.array([np.log1p(len(text)), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), (lengths < 30).mean(), 1 - len(set(lines)) / n])


SHAPE, MEASURES = 6, 8
CONTENT_SIZE, METADATA_SIZE = CLASSES + CLASSES * CLASSES + PAIR_BUCKETS + MEASURES, SHAPE + 2 * SOURCE_BUCKETS


def content_features(text: str) -> np.ndarray:
    """What the content view sees of a whole text."""
    out = np.zeros(CONTENT_SIZE, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return out
    kind = _CLASS[raw]
    single = np.bincount(kind, minlength=CLASSES) / len(raw)
    out[:CLASSES] = np.sqrt(single)
    if len(raw) > 1:
        pairs = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
        out[CLASSES : CLASSES + CLASSES * CLASSES] = np.sqrt(np.bincount(pairs, minlength=CLASSES * CLASSES) / len(pairs))
        mixed = (raw[:-1].astype(np.uint32) * np.uint32(40503) + raw[1:].astype(np.uint32) * np.uint32(2654435)) >> np.uint32(3)
        at = CLASSES + CLASSES * CLASSES
        out[at : at + PAIR_BUCKETS] = np.sqrt(np.bincount(mixed % PAIR_BUCKETS, minlength=PAIR_BUCKETS) / len(mixed))
    words = text.split()
    if words:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[-MEASURES:] = (
            len(counts) / n, max(counts.values()) / n, same / n, np.log1p(n) / 10,
            lengths.mean() / 10, lengths.std() / 10, (lengths == 1).mean(), np.log(len(counts)) / (np.log(n) or 1.0),
        )
    return out


def metadata_features(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """What the metadata view sees."""
    out = np.zeros(METADATA_SIZE, np.float32)
    out[:SHAPE] = _shape(text)
    for k, value in enumerate((source, lang)):
        out[SHAPE + k * SOURCE_BUCKETS + zlib.crc32((value if value is not None else "\0").encode("utf-8", "replace")) % SOURCE_BUCKETS] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 20, start: Logistic | None = None) -> Logistic:
    """Ridge logistic regression by Newton's method, from `start` and in its scale if there is one."""
    mean, scale = (start.mean, start.scale) if start else (x.mean(axis=0), x.std(axis=0) + 1e-3)
    z = np.c_[(x - mean) / scale, np.ones(len(x))].astype(np.float64)
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.r_[start.weights, start.bias] if start else np.zeros(z.shape[1])
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        far = np.abs(step).max()
        w += step * min(1.0, 1.0 / max(far, 1e-9))  # a longer step can overshoot where classes part
        if far < 0.01:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class CoTrained:
    content: Logistic
    metadata: Logistic
    #: Platt scaling of each view, (slope, offset), and the combination's weights (content, metadata, offset).
    platt: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float, float]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Chance of good quality."""
        a, b = (s * v.logit(x) + o for v, x, (s, o) in zip((self.content, self.metadata), (content, metadata), self.platt, strict=True))
        return _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def sure_from(logits: np.ndarray, right: np.ndarray, sure: float = SURE) -> float:
    """The least logit from which verdicts are right as often as `sure`, one more wrong one allowed for; infinite if none is."""
    order = np.argsort(-logits, kind="stable")
    n = np.arange(1, len(order) + 1)
    enough = (np.cumsum(~right[order]) + 1) / (n + 2) <= 1 - sure
    return float(logits[order[np.flatnonzero(enough)[-1]]]) if enough.any() else np.inf


#: What `surest` gives of a row: view and label of the verdict, and the features of both views.
Handed = tuple[int, int, np.ndarray, np.ndarray]


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, surest: Callable[[list[Logistic], list[tuple[float, float]], tuple[int, int]], list[Handed]], rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """Co-train on labelled rows (a third kept for calibration). `surest` takes both views' models, for each view the
    least sureness of a good and of a bad row, and how many of each; it gives unlabelled rows that it hasn't given before."""
    aside = np.arange(len(y)) % 3 == 2 if len(y) >= 30 else np.zeros(len(y), bool)
    fit, check = ~aside, aside if aside.any() else ~aside
    views, all_views = (content[fit], metadata[fit]), (content, metadata)
    extra: list[list[tuple[np.ndarray, int]]] = [[], []]

    def fitted(models) -> list[Logistic]:
        rows = ((np.r_[v, np.stack([x for x, _ in more])] if more else v, np.r_[y[fit], [label for _, label in more]]) for v, more in zip(views, extra, strict=True))
        return [fit_logistic(x, labels, start=m) for m, (x, labels) in zip(models, rows, strict=True)]

    models = fitted((None, None))
    share = y[fit].mean()
    most = (round(handed * share), round(handed * (1 - share)))
    for _ in range(rounds):
        known = [m.logit(x[check]) for m, x in zip(models, all_views, strict=True)]
        least = [(sure_from(z, y[check] == 1), sure_from(-z, y[check] == 0)) for z in known]
        found = surest(models, least, most) if np.isfinite(least).any() else []
        if not found:
            break
        for view in (0, 1):  # in the classes' proportion, so that no view learns that one of them is more frequent
            told = [[f[3 - view] for f in found if f[:2] == (view, label)] for label in (1, 0)]
            part = min(len(t) / max(1, n) for t, n in zip(told, most, strict=True))
            for label, t, n in zip((1, 0), told, most, strict=True):
                extra[1 - view] += [(x, label) for x in t[: round(part * n)]]
        models = fitted(models)
    platt = []
    for model, x in zip(models, (content, metadata), strict=True):
        z = model.logit(x[check])
        line = fit_logistic(z[:, None], y[check], 0.1)
        slope = float(line.weights[0] / line.scale[0])
        platt.append((slope, line.bias - slope * float(line.mean[0])))
    both = np.stack([s * m.logit(x[check]) + o for m, x, (s, o) in zip(models, (content, metadata), platt, strict=True)], axis=1)
    both = np.clip(both, -12, 12)
    line = fit_logistic(both, y[check], 1.0)
    w = line.weights / line.scale
    return CoTrained(models[0], models[1], tuple(platt), (float(w[0]), float(w[1]), float(line.bias - w @ line.mean)))


def _featured(rows: DataFrame) -> DataFrame:
    """content and metadata feature vectors (binary, little-endian float32) beside column y."""

    def run(batches):
        for batch in batches:
            y, text, source, lang = (c.to_pylist() for c in batch.columns)
            content = [content_features(t or "").tobytes() for t in text]
            metadata = [metadata_features(t or "", s, x).tobytes() for t, s, x in zip(text, source, lang, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(content), pa.array(metadata)], ["y", "content", "metadata"])

    return rows.select("y", "text", "source", "lang").mapInArrow(run, "y int, content binary, metadata binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "source", "lang")))


def surest_rows(docs: DataFrame, labelled: set[int]) -> Callable[[list[Logistic], list[tuple[float, float]], tuple[int, int]], list[Handed]]:
    """`surest` of co_train over all rows of `docs` whose id isn't among `labelled`, rows of equal features once.

    Each task keeps the surest of its rows, and of these the surest of all come to the driver, so that what moves is
    bounded by the numbers asked for.
    """
    taken: set[int] = set()

    def surest(models: list[Logistic], least: list[tuple[float, float]], most: tuple[int, int]) -> list[Handed]:
        shared = docs.sparkSession.sparkContext.broadcast((models, least, most, labelled, taken))  # bounded by the parameters

        def run(batches):
            from xxhash import xxh3_64_intdigest

            models, least, most, labelled, taken = shared.value
            best: dict[tuple[int, int], dict[int, tuple[float, bytes, bytes]]] = {(v, label): {} for v in (0, 1) for label in (0, 1)}

            def keep(view: int, label: int) -> None:
                rows = best[view, label]
                best[view, label] = dict(sorted(rows.items(), key=lambda r: (-r[1][0], r[0]))[: most[1 - label]])

            for batch in batches:
                there = [k for k, i in enumerate(batch.column(0).to_pylist()) if i not in labelled]
                text, source, lang = (c.take(pa.array(there, pa.int64())).to_pylist() for c in batch.columns[1:])
                if not there:
                    continue
                views = np.stack([content_features(t or "") for t in text]), np.stack([metadata_features(t or "", s, x) for t, s, x in zip(text, source, lang, strict=True)])
                for view in (0, 1):
                    z = models[view].logit(views[view].astype(np.float64))
                    for label, sure in ((1, z), (0, -z)):
                        for k in np.flatnonzero(sure >= least[view][1 - label]).tolist():
                            row = views[0][k].astype("<f4").tobytes(), views[1][k].astype("<f4").tobytes()
                            key = xxh3_64_intdigest(row[0] + row[1]) >> 1
                            if key not in taken:
                                best[view, label][key] = (float(sure[k]), *row)
                        if len(best[view, label]) > 4 * most[1 - label]:
                            keep(view, label)
            for view, label in best:
                keep(view, label)
            rows = [(view, label, sure, key, a, b) for (view, label), found in best.items() for key, (sure, a, b) in found.items()]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["view", "label", "sure", "key", "content", "metadata"])

        told = _plain(docs).mapInArrow(run, "view int, label int, sure double, key long, content binary, metadata binary")
        # the best of each part of the keys, then the best of these: no group grows with the number of tasks
        wanted = F.col("rank") <= F.when(F.col("label") == 1, most[0]).otherwise(most[1])
        ranked = told.dropDuplicates(["view", "label", "key"]).withColumn("part", F.pmod("key", F.lit(salts(docs.sparkSession))))
        for groups in (("view", "label", "part"), ("view", "label")):
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("sure"), "key"))).where(wanted)
        rows = ranked.orderBy("view", "label", "rank").collect()  # twice the sum of `most` at most
        taken.update(r["key"] for r in rows)
        return [(r["view"], r["label"], *(np.frombuffer(r[c], "<f4").astype(np.float64) for c in ("content", "metadata"))) for r in rows]

    return surest


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> CoTrained | None:
    """Fit on a sample of about `labelled_rows` labelled rows, chosen by hash, and on what the views hand each other of all
    other rows.

    At most about twice as many labelled rows are taken, where ids are shared; equal rows count once. `docs` has doc_id,
    text, source, lang; `labels` has doc_id, quality (0 or 1; null rows aren't used; of several labels of an id the
    smallest holds). None where one of the two classes has no row.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    at = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    # the ids are chosen first: only the chosen rows' texts are moved or read by Python
    some = known.where(at < ((labelled_rows << 30) // sum(sizes.values()) + 1))
    n_some = docs.select(F.col("doc_id").cast("long")).join(F.broadcast(some), "doc_id").count()
    # by a hash of the whole row, so that an id that many rows share doesn't come whole; equal rows once
    row_at = F.pmod(F.xxhash64("doc_id", "text", "source", "lang", F.lit(12)), F.lit(1 << 30))
    rows = _plain(docs).join(F.broadcast(some), "doc_id").where(row_at < (2 * labelled_rows << 30) // max(1, n_some) + 1).distinct()
    got = _featured(rows.select("y", "text", "source", "lang")).toPandas()
    if got["y"].nunique() < 2:
        return None
    got = got.sort_values(["y", "content", "metadata"], kind="stable", ignore_index=True)
    content, metadata = (np.frombuffer(b"".join(got[c]), "<f4").reshape(len(got), -1).astype(np.float64) for c in ("content", "metadata"))
    y = got["y"].to_numpy(np.float64)
    # equal rows stand together in the sorted sample; deal them in a fixed random order
    order = np.random.default_rng(10).permutation(len(y))
    labelled = {r["doc_id"] for r in some.select("doc_id").collect()}  # about labelled_rows of them
    return co_train(content[order], metadata[order], y[order], surest_rows(docs, labelled))


def score(docs: DataFrame, model: CoTrained | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` and quality_score (0 to 1).

    A null text counts as empty; empty and blank texts score 0; without a model every other text scores 1. Nulls in
    source and lang are values of their own. Repeated rows are scored each; an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    kept = docs.select(*keep, *(F.col(c).cast("string").alias(f"_{c}") for c in ("text", "source", "lang")))
    fields = T.StructType([*kept.schema.fields[: len(keep)], T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            text, source, lang = (batch.column(len(keep) + k).to_pylist() for k in range(3))
            text = [t or "" for t in text]
            got = np.ones(len(text))
            if shared.value is not None and text:
                content = np.stack([content_features(t) for t in text]).astype(np.float64)
                metadata = np.stack([metadata_features(*x) for x in zip(text, source, lang, strict=True)]).astype(np.float64)
                got = shared.value.score(content, metadata)
            got = np.where([bool(t.strip()) for t in text], got, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.float64())], [*keep, "quality_score"])

    return kept.mapInArrow(run, fields)

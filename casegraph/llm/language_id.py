"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed character trigrams, learned from labelled documents. A document is a
mixture of languages; expectation-maximisation finds the proportions that make its trigrams likeliest, and the set of
languages is chosen by likelihood less a penalty for each language: starting from the best single one, a language is
added while the gain in log-likelihood is above the penalty.

The log-likelihood is concave in the proportions, so no mixture can gain more over language l than the largest slope
at l towards another language; documents whose slopes are all below the penalty are settled without iterations. That
bound is exact: the screen changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import bounded_batches

UNDETERMINED = "und"
#: Rows of each language from which trigrams are counted, in expectation; the only part that doesn't read all rows.
TRAIN_ROWS = 3000
BUCKET_BITS = 17
#: Languages at most: the model is languages x 2^17 four-byte numbers.
MOST_LANGUAGES = 256
#: Log-likelihood that a further language has to gain, plus PENALTY_RATE times the logarithm of the trigrams.
PENALTY, PENALTY_RATE = 4.0, 2.0
EM_ROUNDS, SMOOTHING = 40, 0.1
#: Characters from which a text's trigrams are counted by bucket first, in parts of as many.
LONG = 1 << 18
#: Characters times languages that are looked at together.
CELLS = 1_600_000
_FOLD = np.uint32(0x9E3779B1)


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each with a space before and after; everything but letters is a space.

    Returns (codes, lengths), lengths with the two spaces.
    """
    return _codes([f" {t.lower()} " for t in texts])


def _codes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = codes < 0x41
    space |= (codes > 0x5A) & (codes < 0x61)
    space |= (codes > 0x7A) & (codes < 0xAA)
    space |= (codes >= 0x2000) & (codes < 0x2070)
    return np.where(space, np.uint32(32), codes), np.array([len(t) for t in lowered], np.int64)


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each trigram of codes."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    with np.errstate(over="ignore"):
        mixed = (a * np.uint32(0x85EBCA6B) + b) * np.uint32(0xC2B2AE35) + c
        mixed ^= mixed >> np.uint32(15)
        mixed *= _FOLD
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


def trigrams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each trigram within a document that isn't mostly space."""
    codes, lengths = text_codes(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = (owner[:-2] == owner[2:]) & (codes[1:-1] != 32)
    return _hashed(codes, bits)[keep], owner[:-2][keep]


def trigram_counts(text: str, bits: int = BUCKET_BITS, step: int = LONG) -> np.ndarray:
    """How often each bucket has a trigram of one text; in parts, so memory doesn't grow with the text's trigrams."""
    out = np.zeros(1 << bits, np.int64)
    lowered = f" {text.lower()} "
    for at in range(0, len(lowered) - 2, step):
        codes, _ = _codes([lowered[at : at + step + 2]])
        out += np.bincount(_hashed(codes, bits)[codes[1:-1] != 32], minlength=1 << bits)
    return out


def has_letter(text: str | None) -> bool:
    """Whether a character is of a letter's category; fractions, superscripts and Roman numerals are numbers."""
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Probability of each bucket in each language, [bucket, language].
    chance: np.ndarray
    bits: int


def train(docs: DataFrame, train_when: Column, train_rows: int = TRAIN_ROWS, bits: int = BUCKET_BITS) -> LanguageModel:
    """Count trigrams of labelled rows of `docs` (doc_id, text, lang) for which `train_when` holds.

    From each language about `train_rows` rows, chosen by a hash, or all if it has fewer. Rows with a null lang or
    text aren't used. Without any such row the model has no languages, and every document is undetermined.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(train_when & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)).alias("at"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), bits)
    limits = {x: min(1 << 20, (train_rows << 20) // n + 1) for x, n in sizes.items()}
    taken = F.lit(False)
    for x in languages:
        taken = taken | ((F.col("lang") == x) & (F.col("at") < limits[x]))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for x in set(langs.tolist()):
                mine = [t for t, y in zip(texts, langs, strict=True) if y == x]
                got, _ = trigrams([t for t in mine if len(t) < LONG], bits)
                sums[x] = sum((trigram_counts(t, bits) for t in mine if len(t) >= LONG), sums.get(x, 0) + np.bincount(got, minlength=1 << bits))
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = labelled.where(taken).select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    packed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    chance = np.zeros((1 << bits, len(languages)), np.float64)
    column = {x: k for k, x in enumerate(languages)}
    got = packed.toPandas()  # buckets x languages at most
    np.add.at(chance, (got["bucket"].to_numpy(np.int64), got["lang"].map(column).to_numpy(np.int64)), got["n"].to_numpy(np.float64))
    total = chance.sum(axis=0, keepdims=True)
    background = chance.sum(axis=1, keepdims=True) + 0.5
    background /= background.sum()
    weight = SMOOTHING * np.maximum(total, 1.0) / 10
    chance = (chance + weight * background) / (total + weight)
    return LanguageModel(languages, chance.astype(np.float32), bits)


def _mixture(p: np.ndarray, weights: np.ndarray, chosen: list[int], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """(log-likelihood, proportions) of the languages `chosen` for trigrams of chances p [trigram, language]."""
    part = p[:, chosen].astype(np.float64)
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(rounds):
        joint = part * share
        new = weights @ (joint / joint.sum(axis=1, keepdims=True)) / weights.sum()
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return float(weights @ np.log(part @ share)), share


def infer(texts: list[str], model: LanguageModel) -> list[tuple[str, float, dict[str, float]]]:
    """For each text its main language, that language's proportion, and the proportions of the chosen set."""
    out: list[tuple[str, float, dict[str, float]]] = [(UNDETERMINED, 0.0, {})] * len(texts)
    live = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    short = [i for i in live if len(texts[i]) < LONG]
    bucket, owner = trigrams([texts[i] for i in short], model.bits)
    _told(out, short, bucket, owner, np.ones(len(bucket)), model)
    for i in live:
        if len(texts[i]) >= LONG:
            counts = trigram_counts(texts[i], model.bits)
            bucket = np.flatnonzero(counts)
            _told(out, [i], bucket, np.zeros(len(bucket), np.int64), counts[bucket].astype(np.float64), model)
    return out


def _told(out: list, live: list[int], bucket: np.ndarray, owner: np.ndarray, weights: np.ndarray, model: LanguageModel) -> None:
    """Set `out` at the places `live`, of which `owner` numbers those that hold a trigram of `bucket`, `weights` times."""
    if not live:
        return
    rows = np.bincount(owner, minlength=len(live))
    starts = np.cumsum(rows) - rows
    sizes = np.bincount(owner, weights, len(live))
    p = model.chance[bucket]
    logs = np.log(p)
    single = np.stack([np.bincount(owner, weights * logs[:, k], len(live)) for k in range(len(model.languages))], axis=1)
    best = single.argmax(axis=1)
    own = np.take_along_axis(p, best[owner][:, None], axis=1)[:, 0]
    slope = np.stack([np.bincount(owner, weights * (p[:, k] / own), len(live)) for k in range(len(model.languages))], axis=1) - sizes[:, None]
    penalty = PENALTY + PENALTY_RATE * np.log(np.maximum(sizes, 1))
    for i, at in enumerate(live):
        chosen, share = [int(best[i])], np.ones(1)
        if slope[i].max() > penalty[i]:
            mine, w = (x[starts[i] : starts[i] + rows[i]] for x in (p, weights))
            now = float(single[i, best[i]])
            while len(chosen) < len(model.languages):
                mixed = mine[:, chosen].astype(np.float64) @ share
                gains = w @ (mine / mixed[:, None]) - sizes[i]
                gains[chosen] = -np.inf
                tried = [(*_mixture(mine, w, [*chosen, int(k)]), int(k)) for k in np.flatnonzero(gains > penalty[i])]
                if not tried or (top := max(tried, key=lambda x: x[0]))[0] - now <= penalty[i]:
                    break
                now, share, chosen = top[0], top[1], [*chosen, top[2]]
        shares = {model.languages[k]: float(x) for k, x in zip(chosen, share, strict=True)}
        main = max(shares, key=lambda x: (shares[x], x))
        out[at] = (main, min(1.0, shares[main]), shares)


def told_fields() -> list[T.StructField]:
    return [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())]


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` and lang_pred string, score double (the language's proportion), languages string.

    Only column text is looked at. Null texts and texts without a letter are undetermined, with score 0. `languages`
    is the chosen set with its proportions, largest first. Repeated rows are told each; empty tables stay empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # MOST_LANGUAGES x 2^BUCKET_BITS x 4 bytes at most
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = T.StructType([*kept.schema.fields[:-1], *told_fields()])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            told: list = []
            at, most = 0, max(20_000, CELLS // max(1, len(shared.value.languages)))
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") < most):
                    size += len(texts[to] or "")
                    to += 1
                told += infer(texts[at:to], shared.value)
                at = to
            names = [x[0] for x in told]
            sets = [", ".join(f"{k} {v:.2f}" for k, v in sorted(x[2].items(), key=lambda y: (-y[1], y[0]))) for x in told]
            columns = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array([x[1] for x in told], pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "languages"])

    return kept.mapInArrow(run, fields)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

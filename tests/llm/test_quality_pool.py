"""What the views of co-training hand each other."""

import numpy as np
from pyspark.sql import functions as F

from casegraph.llm import common, quality


def test_surest_of_all_rows(spark, sf_dir):
    """The rows handed over are the surest of the whole table, equal ones once, none of a labelled id, none twice."""
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    rng = np.random.default_rng(1)
    models = [quality.Logistic(np.zeros(n), np.ones(n), rng.normal(size=n), 0.1) for n in (quality.CONTENT_SIZE, quality.METADATA_SIZE)]
    labelled, least, most = {3, 4, 5}, [(1.0, 0.5), (np.inf, 2.0)], (7, 30)
    rows = [r for r in docs.collect() if r["doc_id"] not in labelled]
    told = {}
    for r in rows:
        x = quality.content_features(r["text"] or "").astype("<f4"), quality.metadata_features(r["text"] or "", r["source"], r["lang"]).astype("<f4")
        for view in (0, 1):
            z = float(models[view].logit(x[view].astype(np.float64)))
            for label, sure in ((1, z), (0, -z)):
                if sure >= least[view][1 - label]:
                    told.setdefault((view, label), {})[x[0].tobytes() + x[1].tobytes()] = sure
    surest, given = quality.surest_rows(docs, labelled), set()
    for _ in range(3):
        got = surest(models, least, most)
        for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
            mine = [a.astype("<f4").tobytes() + b.astype("<f4").tobytes() for v, y, a, b in got if (v, y) == (view, label)]
            want = sorted((s for k, s in told.get((view, label), {}).items() if k not in given), reverse=True)[: most[1 - label]]
            assert len(set(mine)) == len(mine) and np.allclose(sorted((told[view, label][k] for k in mine), reverse=True), want)
        given |= {a.astype("<f4").tobytes() + b.astype("<f4").tobytes() for _, _, a, b in got}


def test_sureness_is_proven():
    logits = np.arange(100.0)
    right = logits >= 40
    assert quality.sure_from(logits, right, 0.9) == 35  # from there 60 are right and 5 wrong
    assert quality.sure_from(logits, right, 0.999) == np.inf and quality.sure_from(logits[:0], right[:0]) == np.inf


def test_exchange_helps_the_weaker_view_and_never_takes_unproven_labels():
    rng = np.random.default_rng(5)

    def rows(n):
        y = rng.integers(0, 2, n)
        return np.c_[y * 6 - 3 + rng.normal(size=n), rng.normal(size=n)], np.c_[y - 0.5 + rng.normal(size=(n)), rng.normal(size=(n, 3))], y.astype(float)

    labelled, pool, test = rows(300), rows(4000), rows(4000)
    left = np.ones(4000, bool)

    def surest(models, least, most):
        out = []
        for view in (0, 1):
            z = models[view].logit(pool[view])
            for label, sure in ((1, z), (0, -z)):
                at = np.flatnonzero(left & (sure >= least[view][1 - label]))
                for k in at[np.argsort(-sure[at])][: most[1 - label]]:
                    left[k] = False
                    out.append((view, label, pool[0][k], pool[1][k]))
        return out

    alone = quality.co_train(*labelled, lambda *_: [], rounds=3)
    both = quality.co_train(*labelled, surest, rounds=3)
    accuracy = lambda m: ((m.metadata.logit(test[1]) > 0) == (test[2] == 1)).mean()
    assert (~left).sum() > 300 and accuracy(both) >= accuracy(alone) - 0.01 and abs(both.metadata.weights[0]) > 0
    assert ((both.score(test[0], test[1]) > 0.5) == (test[2] == 1)).mean() > 0.99


def test_logistic_is_the_optimum():
    """Newton's fit against plain descent of the same loss."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (x @ [1.0, -0.4, 2.0] + rng.normal(size=400) > 0.5).astype(float)
    got = quality.fit_logistic(x, y, steps=60)
    z, w = np.c_[(x - got.mean) / got.scale, np.ones(400)], np.zeros(4)
    keep = np.array([2.0, 2.0, 2.0, 1e-3])
    for _ in range(20_000):
        w -= 0.002 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + keep * w)
    assert np.allclose(np.r_[got.weights, got.bias], w, atol=0.02)

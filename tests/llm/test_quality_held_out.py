"""The quality classifier on labels that it wasn't fitted on."""

import numpy as np
from pyspark.sql import functions as F

from casegraph.llm import common, quality


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").where("quality is not null")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~aside))
    got = quality.score(docs, model).join(labels.where(aside), "doc_id").select("quality_score", "quality").toPandas()
    good, bad = (got.quality_score[got.quality == k].to_numpy() for k in (1, 0))
    assert len(good) > 10 and len(bad) > 10 and (good[:, None] > bad[None, :]).mean() > 0.8

"""The limit of the language stage counts every labelled text, not the first 2000 by hash."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import langid


def test_every_text_counts(spark, monkeypatch):
    # 3000 different texts; the score is a function of the number in the text
    docs = spark.range(3000).select(F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("x").alias("lang"))
    docs = docs.unionByName(docs.limit(500))
    monkeypatch.setattr(langid, "predict", lambda d, model: d.select("lang", "_hash", F.lit("x").alias("lang_pred"), (0.5 + F.substring("text", 6, 9).cast("long") / 10000).alias("score")))
    model = langid.Model(["x", "y"], *[np.zeros(0)] * 4)
    want = float(np.quantile([0.5 + k / 10000 for k in range(3000)], 0.01))
    assert abs(langid.least_score(docs, model) - (0.25 + want / 2)) < 1e-4

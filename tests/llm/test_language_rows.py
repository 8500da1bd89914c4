"""No language is lost, whatever ids, copies and numbers its rows have."""

import random

from pyspark.sql import functions as F

from plumbline.llm import langid


def test_languages_with_one_repeated_id_null_ids_or_copies_are_learned(spark):
    rng = random.Random(8)
    letters = {"en": "abcdefgh", "l1": "ijklmnop", "l2": "qrstuvwx", "l3": "äöüßéèçà", "l4": "αβγδεζηθ", "l5": "абвгдежз"}
    prose = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(12))
    rows = [(i, prose("en"), "en") for i in range(300)]
    for k, lang in enumerate(["l1", "l2", "l3"]):
        rows += [(7 + k, prose(lang), lang) for _ in range(8000)]
    rows += [(None, prose("l4"), "l4") for _ in range(8000)] + [(11, "абв гдеж", "l5")] * 8000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(docs)
    assert model.languages == sorted(letters)
    told = langid.predict(docs.select("text", "lang"), model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(told) == 6 and all(r["right"] > 0.99 for r in told)


def test_the_sample_does_not_depend_on_ids_or_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) + str(i) for _ in range(6)), rng.choice(["x", "y"])) for i in range(3000)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    two = one.withColumn("doc_id", F.lit(None).cast("long")).unionByName(one).repartition(7)
    a, b = langid.fit(one, 50, 80), langid.fit(two, 50, 80)
    assert a.languages == b.languages and (a.landmarks == b.landmarks).all()

"""The pipeline's language stage rejects letters that are in no language of its model, and keeps the clean documents."""

import random

import pytest


def junk():
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    return {
        -1: " ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(120)),
        -2: "qx " * 200,
        -3: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 3,
        -4: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 3,
        -5: "Ã¼Ã¤Ã¶Ã©Ã¨ Ã±Ã³ â€™Ã©tÃ© Ã  lâ€™Ã©cole ÃœbergrÃ¶ÃŸe " * 10,
        -6: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(800)),
    }


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_letter_junk_and_foreign_languages_go(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    planted = spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in junk().items()], docs.schema)
    kept = {r["doc_id"] for r in p.language_id(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    assert not kept & set(junk())
    clean = {r["doc_id"] for r in docs.where("text RLIKE '[A-Za-z]{2}'").select("doc_id").collect()}
    assert len(clean - kept) <= 0.002 * len(clean)

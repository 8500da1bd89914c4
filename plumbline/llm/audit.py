"""How filters overlap: what each of five filters removes in every order that they can be applied in (operator 12)."""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import stage, unstage

FILTERS = "ABCDE"
#: What is counted in every cell: documents, those of good quality, toxic ones.
COUNTS = ["n", "good", "toxic"]


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D): which of the first four conditions each whole text fails, and its SHA-256.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * capitals A-Z > 10 * code points. D: holds one of
    ``#$%&*|``. A NULL text is an empty one, and fails A alone; a NULL lang is the part "".
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[ \t-\r]+"), "")
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.size(words) < 100).alias("A"), (F.size(F.array_distinct(words)) * 100 < F.size(words) * 80).alias("B"),
        (capitals.cast("long") * 100 > F.char_length("text").cast("long") * 10).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): how many documents fail just this set of filters.

    E: the text equals that of a smaller doc_id, anywhere in the table. Texts are compared by SHA-256. A document without
    doc_id has no smaller one, and is none; rows that share the smallest doc_id of a text all pass. A document is good
    (toxic) if any row of ``labels`` for its doc_id has quality (toxic) 1.
    """
    flags = ["A", "B", "C", "D"]
    once = failures(docs).groupBy("doc_id", "part", "digest", *flags).agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("_good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("_toxic"))
    # rows without doc_id match nothing; their own hash spreads them over the tasks of the join
    keyed = once.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.hex("digest"))).withColumn("_known", F.col("doc_id").isNotNull())
    told = told.select(F.col("doc_id").cast("string").alias("_key"), F.lit(True).alias("_known"), "_good", "_toxic")
    known = keyed.join(told, ["_key", "_known"], "left").withColumn("_good", F.coalesce("_good", F.lit(False))).withColumn("_toxic", F.coalesce("_toxic", F.lit(False)))
    # copies are counted before they are brought together: a text has a row for each part and label, however many copies
    texts = known.groupBy("digest", "part", *flags, "_good", "_toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("_least"), F.min_by("n", "doc_id").alias("_at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("_unnamed")
    )
    least = F.min("_least").over(Window.partitionBy("digest"))
    passing = F.col("_unnamed") + F.when(F.col("_least") == least, F.col("_at_least")).otherwise(0)
    both = texts.withColumn("_passing", passing).withColumn("_e", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("_passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("_passing")).alias("n")))))
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("_e.n")).otherwise(0))
    return both.where("_e.n > 0").groupBy("part", *flags, F.col("_e.E").alias("E")).agg(F.sum("_e.n").alias("n"), counted("_good").alias("good"), counted("_toxic").alias("toxic"))


def _mask(letters) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


def survivors(cell: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that pass all filters of a subset, for all 32 subsets.

    From one CUBE over the failure flags and part: in a grouping set that keeps part, the row whose kept flags are all
    false counts the documents that pass these filters, whatever the other filters say. Bit k of mask: filter k is kept.
    """
    cube = cell.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.grouping(x).alias(f"_{x}") for x in [*FILTERS, "part"]))
    clean = cube.where("_part = 0 AND " + " AND ".join(f"(_{x} = 1 OR NOT {x})" for x in FILTERS))
    mask = sum(((1 - F.col(f"_{x}").cast("int")) * (1 << k) for k, x in enumerate(FILTERS)), F.lit(0))
    every = cell.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return every.join(clean.select("part", mask.alias("mask"), *COUNTS), ["part", "mask"], "left").na.fill(0, COUNTS)


def _steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: the subsets before and after each, and its filter."""
    rows = [(o := "".join(p), k + 1, o[k], _mask(o[:k]), _mask(o[: k + 1])) for p in permutations(FILTERS) for k in range(5)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def _pairs(spark: SparkSession) -> DataFrame:
    """Each filter with each subset of the other four, and in how many of the 120 orders just this subset precedes it."""
    rows = []
    for x in FILTERS:
        others = FILTERS.replace(x, "")
        rows += [(x, _mask(s), _mask(s + (x,)), factorial(k) * factorial(4 - k)) for k in range(5) for s in combinations(others, k)]
    return spark.createDataFrame(rows, "filter string, before int, after int, orders int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with the documents kept and removed there.

    Texts are read once, to count the documents of each part for each set of failed filters; all orders follow from the
    survivors of the 32 subsets, two of which are joined for a step. kept: after the step; removed: at it; redundant: fail
    its filter but were removed before; unique_fails: fail its filter alone; good_lost, toxic_lost: labelled so among the
    removed; shapley: what its filter removes, over all 120 orders. An empty table has no parts and no rows; repeated rows
    count each; other columns are ignored.
    """
    spark = docs.sparkSession
    counted = stage(cells(docs, labels), "filter_cells")
    passing = stage(survivors(counted), "filter_survivors")
    unstage(counted)
    side = lambda name: passing.select("part", F.col("mask").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in COUNTS))
    gone = F.col("n_before") - F.col("n_after")
    joined = lambda table: side("before").join(F.broadcast(table), "before").join(side("after"), ["part", "after"])  # noqa: E731  # 600 or 80 rows, whatever the input
    fails = F.sum(F.when(F.col("before") == 0, gone).otherwise(0))
    alone = F.sum(F.when(F.col("after") == 31, gone).otherwise(0))
    filters = joined(_pairs(spark)).groupBy("part", "filter").agg(F.sum(gone * F.col("orders")).alias("shapley"), fails.alias("_fails"), alone.alias("unique_fails"))
    steps = joined(_steps(spark)).join(filters, ["part", "filter"])
    return steps.select(
        "part", "filter_order", "step", F.col("n_after").alias("kept"), gone.alias("removed"), (F.col("_fails") - gone).alias("redundant"), "unique_fails",
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"), "shapley",
    )


def op12_filter_interactions(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Walks every order over the sets of failed filters, one after the other; no subsets, no cube.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS dd,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, a, b, c, dd, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT v.x || w.x || y.x || z.x || u.x AS o FROM letters v, letters w, letters y, letters z, letters u
  WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
met AS (
  SELECT part, o, n, good, toxic, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN dd THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS failed,
    least(CASE WHEN a THEN instr(o, 'A') ELSE 9 END, CASE WHEN b THEN instr(o, 'B') ELSE 9 END, CASE WHEN c THEN instr(o, 'C') ELSE 9 END, CASE WHEN dd THEN instr(o, 'D') ELSE 9 END, CASE WHEN e THEN instr(o, 'E') ELSE 9 END) AS first
  FROM cells, orders),
steps AS (
  SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS x,
    CAST(coalesce(sum(n) FILTER (first > k), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (first = k), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (first < k AND list_contains(failed, substr(o, k, 1))), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed = [substr(o, k, 1)]), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (first = k), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (first = k), 0) AS BIGINT) AS toxic_lost
  FROM met, range(1, 6) r(k) GROUP BY part, o, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM steps
"""

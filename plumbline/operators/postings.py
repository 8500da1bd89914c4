"""Search for parts of names over a persisted table of postings: the rarest term is looked up, the others are only checked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from plumbline.operators.filters import script_terms, variants
from plumbline.runtime import sized, stage

#: Postings are kept in so many buckets; a search reads those of its own pieces.
BUCKETS = 32
#: Names that are told out into pairs are dealt over tasks of about so many.
NAMES = 10_000


def _pieces(s: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(s) - size + 1), lambda i: F.substring(s, i, size)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(names: DataFrame, path: str) -> None:
    """Writes postings of (id, name): names in lower case with their ids, and for every piece of one to three characters the names that hold it.

    NULL and empty names are in no posting. A name that many ids share is posted once.
    """
    rows = stage(names.where("name <> ''").select("id", F.lower("name").alias("name")).distinct(), "names")
    rows.write.mode("overwrite").parquet(f"{path}/owners")
    sizes = F.sequence(F.lit(1), F.least(F.char_length("name"), F.lit(3)))
    grams = rows.select("name").distinct().select("name", F.explode(F.flatten(F.transform(sizes, lambda k: _pieces(F.col("name"), k)))).alias("gram"))
    posted = stage(grams.withColumn("bucket", _bucket(F.col("gram"))), "postings")
    posted.repartition(BUCKETS, "bucket").sortWithinPartitions("gram", "name").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counted = posted.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def terms(queries: DataFrame, smart: bool = False, spellings: bool = True) -> DataFrame:
    """(q, term, variants) of (q, text): terms between blanks (``smart``: a text of one term at changes of script), spellings in lower case; only as written without ``spellings``."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def split(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[list[str]]:
            parts = (text or "").replace("　", " ").split()
            found = script_terms(parts[0]) if smart and len(parts) == 1 else list(dict.fromkeys(parts))
            return [list(dict.fromkeys(v.lower() for v in variants(t))) if spellings else [t] for t in found]

        return texts.map(one)

    return queries.select("q", F.posexplode(split("text")).alias("term", "variants"))


def _leads(spark: SparkSession, path: str, queries: DataFrame, smart: bool, spellings: bool):
    """The terms of all queries, the cheapest term of each, its spellings with their rarest pieces, and the buckets of those."""
    asked = stage(terms(queries, smart, spellings), "terms")
    spelled = asked.select("q", "term", F.explode("variants").alias("v"))
    probes = spelled.select("v").distinct().select("v", F.explode(_pieces(F.col("v"), F.least(F.char_length("v"), F.lit(3)))).alias("gram"))
    probes = stage(probes.withColumn("bucket", _bucket(F.col("gram"))), "probes")
    # at most BUCKETS numbers
    among = sorted(r["bucket"] for r in probes.select("bucket").distinct().collect())
    counts = spark.read.parquet(f"{path}/counts").where(F.col("bucket").isin(among))
    rarest = probes.join(counts, ["bucket", "gram"], "left").groupBy("v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "bucket")).alias("r"))
    rarest = stage(rarest.select("v", "r.n", "r.gram", "r.bucket"), "rarest")
    cost = spelled.join(rarest, "v").groupBy("q", "term").agg(F.sum("n").alias("n"))
    lead = stage(cost.groupBy("q").agg(F.min(F.struct("n", "term")).alias("l"), F.count(F.lit(1)).alias("terms")).select("q", "l.n", "l.term", "terms").where("n > 0"), "lead")
    first = spelled.join(lead.select("q", "term"), ["q", "term"]).join(rarest.where("n > 0"), "v")
    wanted = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())
    return asked, lead, first, wanted


def search(spark: SparkSession, path: str, queries: DataFrame, smart: bool = False, spellings: bool = True) -> DataFrame:
    """(q, id): ids of which every term of the query is in one of their names, in one spelling or another.

    Each spelling is looked up under its rarest piece. The term whose spellings have the fewest postings gives the candidates;
    the other terms are checked on the candidates' names, so postings of frequent terms are not read through. A query
    without terms finds nothing; a term that no name holds ends its query. Without ``spellings`` terms, in lower case already,
    are only looked for as written.
    """
    asked, lead, first, wanted = _leads(spark, path, queries, smart, spellings)
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted))
    held = first.select("v", "gram", "bucket").distinct().join(postings, ["bucket", "gram"]).where(F.col("name").contains(F.col("v"))).select("v", "name")
    owners = spark.read.parquet(f"{path}/owners")
    candidates = stage(first.select("q", "v").join(held, "v").join(owners, "name").select("q", "id").distinct(), "candidates")
    others = asked.join(lead.select("q", F.col("term").alias("_lead")), "q").where("term <> _lead")
    named = candidates.join(owners, "id")
    checked = named.join(others, "q").where(F.exists("variants", lambda v: F.col("name").contains(v))).groupBy("q", "id").agg(F.count_distinct("term").alias("met"))
    return candidates.join(lead.select("q", "terms"), "q").join(checked, ["q", "id"], "left").where(F.coalesce("met", F.lit(0)) == F.col("terms") - 1).select("q", "id")


def _packed(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the values of ``by``, NULL too, in lists; many of one ``by`` are in up to 64."""
    values = F.transform(F.collect_list(F.struct(value)), lambda x: x[value])
    return df.groupBy(by, F.pmod(F.xxhash64(value), F.lit(64)).alias("_p")).agg(values.alias(value)).drop("_p")


def told(spark: SparkSession, path: str, asked: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc, id): for each (doc, q) the (id, name) whose name holds every term of the text q as it is written; postings of names only.

    Both without repeated rows. Where each doc has one text and each id one name, every pair is told once. Names of the looked up pieces meet their ids
    first; terms are checked where a name meets a query, and no pairs are shuffled or written.
    """
    terms_of, lead, first, wanted = _leads(spark, path, asked.select("q", F.col("q").alias("text")).distinct(), False, False)
    others = terms_of.join(lead.select("q", F.col("term").alias("_lead")), "q").where("term <> _lead").groupBy("q").agg(F.collect_list(F.element_at("variants", 1)).alias("others"))
    asks = first.select("q", "v", "gram", "bucket").join(sized(stage(others, "others")), "q", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    asks = stage(asks.join(sized(stage(_packed(asked, "q", "doc"), "docs")), "q"), "asks")
    held = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted)).join(sized(asks.select("bucket", "gram").distinct()), ["bucket", "gram"], "left_semi").select("gram", "name")
    names = stage(_packed(owners, "name", "id"), "owned")
    n = int(min(20_000, names.count() // NAMES + 1))
    met = held.repartition(n, "name").join(names.repartition(n, "name").hint("merge"), "name").join(sized(asks.drop("bucket")), "gram")
    holds = F.col("name").contains(F.col("v")) & F.forall("others", lambda w: F.col("name").contains(w))
    return met.where(holds).select(F.explode("doc").alias("doc"), "id").select("doc", F.explode("id").alias("id"))

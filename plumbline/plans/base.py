"""What the registered queries share: the registry, and the driver's star schema read as listings.

How the tables stand in: part = unit (brand = building, type = layout, size = floor), lineitem = adverts (quantity = price,
line status O = active, supplier = site, ship date = first seen), orders = closed sales, events = price history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def adverts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as adverts."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("advert_id"), F.col("l_partkey").alias("unit_id"), F.col("l_suppkey").alias("site"), F.col("l_quantity").cast("long").alias("price"),
        (F.col("l_linestatus") == "O").alias("is_active"), F.col("l_shipdate").alias("seen_at"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey"), F.col("l_linenumber"),
    )


ADVERTS = "(SELECT l_orderkey * 10 + l_linenumber AS advert_id, l_partkey AS unit_id, l_suppkey AS site, CAST(l_quantity AS BIGINT) AS price, l_linestatus = 'O' AS is_active, l_shipdate AS seen_at, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, l_orderkey, l_linenumber FROM lineitem)"


def history(spark: SparkSession, d: str) -> DataFrame:
    """events as price records."""
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("unit_id"), F.col("event_type").alias("site"), F.floor("value").cast("long").alias("price"), "ts")


HISTORY = "(SELECT event_id, user_id AS unit_id, event_type AS site, CAST(floor(value) AS BIGINT) AS price, ts, CAST(ts AS DATE) AS day FROM events)"
UNITS = "(SELECT p_partkey AS unit_id, p_brand AS building, p_type AS layout, p_size AS floor, p_retailprice AS area, p_name AS name FROM part)"


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("building"), F.col("p_type").alias("layout"), F.col("p_size").alias("floor"), F.col("p_retailprice").alias("area"), F.col("p_name").alias("name"))


def mean(c: str):
    """An average that does not depend on the order of addition: exact sum over count."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)


MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / count({0})"


def spoken(forms: list[tuple[str, str]], key: str = "k") -> tuple[str, str]:
    """SQL, for both engines, of a text in many spellings, by ``key``, and of what must be read out of it.

    forms: text and value, as SQL; after the last form comes one more, a NULL text.
    """
    cases = [" ".join(f"WHEN {i} THEN {f[side]}" for i, f in enumerate(forms)) for side in (0, 1)]
    return tuple(f"CASE {key} % {len(forms) + 1} {c} END" for c in cases)


def told(forms: list[tuple[str, str]], key: str = "k") -> Column:
    return F.expr(spoken(forms, key)[0])


def meant(forms: list[tuple[str, str]], kind: str, key: str = "k") -> str:
    return f"CAST({spoken(forms, key)[1]} AS {kind})"


KEYS = "(SELECT p_partkey AS k, p_size AS s FROM part)"


#: Rows whose texts are read out are dealt over tasks of about so many: a small file is one task, however much is read out of a row.
ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as their number asks for; few stay where they are."""
    n = df.count() // ROWS + 1
    return df if n == 1 else df.repartition(int(min(n, 20_000)))


def keys(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")))


#: DuckDB: Ratcliff and Obershelp's ratio of all (x, y) of ``compared``, as ``ratios`` (x, y, ratio). The longest common part, the
#: first of equal ones on the left and then on the right, is matched; so are what precedes and what follows it, in turn.
RATIOS = """matched AS (
  SELECT x, y, x AS a, y AS b, 0 AS m FROM compared
  UNION ALL
  SELECT x, y, c.a, c.b, c.m FROM (
    SELECT x, y, unnest([{'a': left(a, best.i - 1), 'b': left(b, strpos(b, substr(a, best.i, -best.n)) - 1), 'm': -best.n},
      {'a': substr(a, best.i - best.n), 'b': substr(b, strpos(b, substr(a, best.i, -best.n)) - best.n), 'm': 0}]) AS c
    FROM (SELECT x, y, a, b, list_min(list_filter(flatten(list_transform(range(1, least(length(a), length(b)) + 1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: {'n': -n, 'i': i}))),
      lambda k: contains(b, substr(a, k.i, -k.n)))) AS best FROM matched WHERE a <> '' AND b <> '')
    WHERE best IS NOT NULL)),
ratios AS (SELECT x, y, 2.0 * sum(m) / (length(x) + length(y)) AS ratio FROM matched GROUP BY x, y)"""

#: DuckDB, after RATIOS: similarity of two names by their words, as ``likeness`` (x, y, similarity).
LIKENESS = """worded AS (SELECT x, y, ratio, string_split_regex(x, '\\s+') AS v, string_split_regex(y, '\\s+') AS w FROM ratios),
shared AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(v), len(w)) + 1), lambda i: v[1:i] = w[1:i])), 0) AS p FROM worded),
likeness AS (SELECT x, y, CASE WHEN x = y THEN 1.0 WHEN p = 0 THEN ratio WHEN p < len(v) AND p < len(w) THEN least(ratio, 0.6) WHEN p < len(v) OR p < len(w) THEN least(ratio, 0.65) ELSE 0.95 END AS similarity FROM shared)"""

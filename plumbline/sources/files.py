"""Readers and writers: CSV in Japanese encodings, JSON feeds, ledgers of loaded periods, logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numbers

ENCODINGS = ["UTF-8", "windows-31j", "Shift_JIS"]
# Names of the columns of sale files, the first that is filled in counts.
SALE_HEADERS = {
    "property_type": ["種類", "Type"], "district_name": ["市区町村名", "Municipality"], "area_name": ["地区名", "DistrictName"], "period": ["取引時期", "取引時点", "Period"],
    "price": ["取引価格（総額）", "取引価格", "TradePrice"], "area": ["面積（㎡）", "面積", "Area"], "layout": ["間取り", "FloorPlan"], "built_year": ["建築年", "BuildingYear"],
    "structure": ["建物の構造", "Structure"], "use": ["用途", "Use"], "city_planning": ["都市計画", "CityPlanning"], "remarks": ["取引の事情等", "備考", "Remarks"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def encoding_of(spark: SparkSession, path: str, header: list[str], encodings: list[str] | None = None) -> str:
    """The first encoding in which the first line of the file names one of the columns in ``header``."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # other charsets than UTF and Latin are refused without it
    for e in encodings or ENCODINGS:
        line = spark.read.option("encoding", e).option("header", False).csv(path).limit(1).collect()
        if line and any(str(v).lstrip("﻿").strip() in header for v in line[0]):
            return e
    raise ValueError(f"none of {encodings or ENCODINGS} gives a known header in {path}")


def csv_files(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV files of a path or glob, all columns as text, with ``source_file``."""
    out = spark.read.option("header", True).option("encoding", encoding_of(spark, path, header)).option("escape", '"').csv(path)
    return out.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in out.columns}).withColumn("source_file", F.col("_metadata.file_name") if "_metadata" in out.columns else F.input_file_name())


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under one name: the first of its aliases that is filled in; NULL if no alias exists."""
    pick = lambda olds: F.coalesce(*[F.nullif(F.trim(F.col(f"`{o}`")), F.lit("")) for o in olds if o in df.columns], F.lit(None).cast("string"))
    return df.select(*[pick(olds).alias(new) for new, olds in names.items()])


def sales(df: DataFrame, feed: bool = False) -> DataFrame:
    """Rows of sale files as typed transactions; ``feed``: rows of the JSON feed, whose prices follow another rule."""
    raw = aliased(df, SALE_HEADERS)
    period, price = numbers.sale_period(F.col("period")), (numbers.sale_price_of_feed if feed else numbers.sale_price)(F.col("price"))
    out = raw.withColumn("transaction_year", period["year"]).withColumn("transaction_quarter", period["quarter"]).withColumn("transaction_price", price)
    out = out.withColumn("floor_area", F.regexp_extract("area", r"([\d.]+)", 1).try_cast("double")).withColumn("built_year", numbers.built_year(F.col("built_year")))
    out = out.withColumn("layout", numbers.layout(F.col("layout"))).withColumn("price_per_sqm", numbers.unit_price(F.col("transaction_price"), F.col("floor_area")))
    key = numbers.transaction_key(*[F.col(c) for c in ("district_name", "area_name", "transaction_year", "transaction_quarter", "transaction_price", "floor_area")])
    return out.withColumn("transaction_id", key).where(F.col("transaction_year").isNotNull() & F.col("transaction_price").isNotNull()).drop("period", "price", "area")


def feed(spark: SparkSession, path: str, code: str | None = None, code_column: str = "MunicipalityCode") -> DataFrame:
    """Landed JSON records, of one municipality if ``code`` is given, as typed transactions."""
    rows = spark.read.json(path)
    return sales(rows.where(F.col(code_column) == code) if code else rows, feed=True)


def not_loaded(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The periods that the ledger does not have as completed."""
    return wanted.join(ledger.select(*keys).distinct(), keys, "left_anti")


def latest_period(df: DataFrame, year: str, quarter: str) -> DataFrame:
    return df.agg(F.max(F.struct(F.col(year).alias("year"), F.col(quarter).alias("quarter"))).alias("p")).select("p.*")


def missing_periods(df: DataFrame, year: str, quarter: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(year, quarter) from first to last that no row has."""
    n = F.explode(F.sequence(F.lit(first[0] * 4 + first[1] - 1), F.lit(last[0] * 4 + last[1] - 1))).alias("n")
    every = df.sparkSession.range(1).select(n).select(F.floor(F.col("n") / 4).cast("int").alias(year), (F.col("n") % 4 + 1).cast("int").alias(quarter))
    return every.join(df.select(year, quarter).distinct(), [year, quarter], "left_anti")


def add_new(old: DataFrame, new: DataFrame, key: str, price: str) -> DataFrame:
    """Transactions by key: new ones are added, known ones replaced only if their price changed."""
    changed = new.alias("n").join(old.select(F.col(key).alias("_k"), F.col(price).alias("_p")), new[key] == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.col("_p").eqNullSafe(F.col(f"n.{price}"))).select("n.*")
    return old.join(changed.select(key), key, "left_anti").unionByName(changed, True)


def log_lines(spark: SparkSession, path: str, keyword: str | None = None, level: str | None = None) -> DataFrame:
    """JSON lines of a log, by keyword in any field or by level."""
    out = spark.read.json(path)
    if level:
        out = out.where(F.col("level") == level)
    return out.where(F.to_json(F.struct("*")).contains(keyword)) if keyword else out


def tail(logs: DataFrame, at: str, n: int, tie: str | None = None) -> DataFrame:
    return logs.orderBy(F.desc(at), *([tie] if tie else [])).limit(n)


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def export(df: DataFrame, path: str, kind: str = "json", partition_by: list[str] | None = None) -> None:
    """Write as json, csv (with header) or parquet, replacing what was there."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def sitemap(df: DataFrame, url: Column, changed: Column, priority: str = "0.8") -> DataFrame:
    """One line of a sitemap per row."""
    return df.select(F.concat(F.lit("<url><loc>"), url, F.lit("</loc><lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit(f"</lastmod><priority>{priority}</priority></url>")).alias("line"))

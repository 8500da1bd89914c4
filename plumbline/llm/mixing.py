"""Mixing sources to target weights along a time-varying curriculum (operator 1).

Each source has a piecewise linear weight schedule over training time 0..1. Its integral is the source's share; shares are
turned into token targets, none above a limit of repeats; the running token demand of a source is its integrated schedule
scaled to its target. A document's place in its source's shuffled order is a point of that demand, and inverting the
demand gives its training position; documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import bucketed_prefix
from plumbline.runtime import broadcast_checked, stage

#: Documents of one source in a bucket of the shuffled order, about.
PER_BUCKET = 4_000


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_schedule(sources: DataFrame, weights: list[float], tilt: float = 0.5) -> DataFrame:
    """(source, knots): ``weights`` in turn to the sources in code point order, NULL last.

    A weight is the integral of its schedule, which falls from ``1 + tilt`` to ``1 - tilt`` times the weight for the first,
    third, ... source and rises so for the others.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    lean = F.when(place % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    knot = lambda t, v: F.struct(F.lit(float(t)).alias("t"), v.alias("w"))
    return sources.select("source", F.array(knot(0, w * (1 + lean)), knot(1, w * (1 - lean))).alias("knots"))


def targets(sizes: DataFrame, schedule: DataFrame, share: float, limit: float) -> DataFrame:
    """(sid, source, source_size, target, area, segments) per source.

    ``share`` times all sizes is dealt out by integrated weight; a target stops at ``limit`` times its source's size and
    the excess goes to the others by weight, until none is above. A source of no size gets 0. sid numbers the sources.
    """
    joined = sizes.join(schedule.withColumnRenamed("source", "_s"), sizes["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    pieces = F.expr("""transform(sequence(1, size(knots) - 1), i -> struct(knots[i - 1].t AS t0, knots[i].t AS t1,
        knots[i - 1].w AS w0, knots[i].w AS w1, (knots[i].t - knots[i - 1].t) * (knots[i - 1].w + knots[i].w) / 2 AS area))""")
    with_area = joined.withColumn("_p", pieces).withColumn("area", F.expr("aggregate(_p, 0D, (a, p) -> a + p.area)"))
    segments = F.expr("""transform(sequence(1, size(_p)), i -> struct(_p[i - 1].t0 AS t0, _p[i - 1].t1 AS t1, _p[i - 1].w0 AS w0, _p[i - 1].w1 AS w1,
        aggregate(slice(_p, 1, i - 1), 0D, (a, p) -> a + p.area) AS before))""")
    cap = limit * F.col("source_size")
    every = Window.partitionBy(F.lit(0))
    filled = every.orderBy(F.expr("cap / area"), "sid")
    return (
        with_area.withColumn("segments", segments)
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("cap", cap)
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("_full", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("area").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
        .withColumn("_over", F.expr("cap / area") > F.col("_level"))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_over"), F.expr("cap / area"))).over(every))
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("area") * F.col("_level"))))
        .select("sid", "source", "source_size", "target", "area", "segments")
    )


#: Inverts the integral on the segment that holds area ``a``: w0 x + (w1 - w0) / (2 d) x^2 = a - before, x from t0, d = t1 - t0.
_INVERT = """transform(takes, k -> transform(array(k.middle * area / target), a -> transform(array(element_at(filter(segments, s -> s.before <= a), -1)),
    s -> s.t0 + CASE WHEN a <= s.before THEN 0D ELSE 2 * (a - s.before) / (s.w0 + sqrt(greatest(0D, s.w0 * s.w0 + 2 * (s.w1 - s.w0) / (s.t1 - s.t0) * (a - s.before)))) END)[0])[0])"""


def measured(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` with ``size`` and the hash ``_order`` that shuffles them."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text"))


def assign(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, schedule: DataFrame | None = None, sized: bool = False) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken, takes and positions.

    A source's documents are laid end to end in an order given by a hash of id and text, as often as ``limit`` asks; what
    lies before the source's target is taken, so the last document may be taken in part. ``takes`` has, for each pass in
    which a document is taken, its words and the middle of its place in the demand; ``positions`` the training times.
    NULL and empty texts have size 0 and are never taken; NULL is a source of its own; repeated rows are dealt with
    one by one; without rows the result is empty. With ``sized``, docs comes from ``measured`` and needs no text.
    """
    own = [c for c in docs.columns if c not in ("size", "_order", "source_size", "target", "taken", "takes", "positions")]
    rows = docs if sized else measured(docs.select(*own))
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sizes")
    if schedule is None:
        schedule = cyclic_schedule(sizes, list(weights))
    plan = stage(targets(sizes.drop("n_docs"), schedule, share, limit), "targets")
    most = sizes.agg(F.max("n_docs")).first()[0] or 0
    buckets = 1 << max(0, (most // PER_BUCKET).bit_length())
    placed = rows.join(broadcast_checked(plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_bucket", F.expr(f"pmod(_order, {buckets})"))
    placed = bucketed_prefix(placed, ["sid"], "_bucket", [F.col("_order"), F.col("doc_id")], F.col("size"), "_before")
    passes = int(-(-limit // 1))
    takes = f"""filter(transform(sequence(0, {passes - 1}), p -> named_struct('pass', p,
        'words', least(size, greatest(0L, cast(round(target) AS bigint) - p * source_size - _before)),
        'middle', p * source_size + _before + least(size, greatest(0L, cast(round(target) AS bigint) - p * source_size - _before)) / 2)), k -> k.words > 0)"""
    return (
        placed.withColumn("takes", F.expr(takes))
        .withColumn("taken", F.expr("aggregate(takes, 0L, (a, k) -> a + k.words)"))
        .withColumn("positions", F.expr(_INVERT))
        .select(*own, "size", "source_size", "target", "taken", "takes", "positions")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The training order: whole documents, once per pass that takes at least half of their words, with ``position``.

    Documents without words cost nothing and come once, at the start. Rows are range-sorted by position; ties by id.
    """
    own = [c for c in docs.columns if c != "position"]
    planned = assign(docs.select(*own), **how)
    times = F.expr("CASE WHEN size = 0 THEN array(0D) ELSE transform(filter(arrays_zip(takes, positions), z -> 2 * z.takes.words >= size), z -> z.positions) END")
    out = planned.select(*own, F.explode(times).alias("position"))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = assign(stage(measured(docs).drop("text"), "measured"), sized=True).select("doc_id", "size", "source_size", "target", "taken", "source", F.try_element_at("positions", F.lit(1)).alias("first_position"))
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")

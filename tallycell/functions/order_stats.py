"""Exact ranks, quantiles and step-up adjustment for groups of any size.

A plain window per group puts a whole group into one task.  Here each group is first cut into value
buckets (approximate split points, mergeable and small), the running sum is taken inside a bucket, and
the few bucket totals of a group are accumulated separately.  Results are exact; the split points only
decide which task does the work.  Rows should be pre-aggregated by value, which removes hot ties on the
map side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.session import checkpointed

BUCKET_ROWS = 4096
TASK_ROWS = 1 << 19
MAX_BUCKETS = 1000  # split points of one group; beyond it buckets grow, results stay exact


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a grouped summary back.

    With no keys the summary is one row of scalars (or a short array of cut points); it is read once and
    put into the plan as literals, which keeps long compositions from repeating it as nested subqueries.
    """
    if keys:
        return df.join(small, list(keys), how)
    row = small.first()
    values = [row[i] if row is not None else None for i in range(len(small.columns))]
    return df.select("*", *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, small.schema.fields)])


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as its number of rows asks for, or that of ``like``, a table that is cheaper to count.

    Tasks that are put together by the size of their compressed input sort many times that size in memory.
    """
    tasks = math.ceil((like or df).count() / TASK_ROWS)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), *keys)


def bucketed(df: DataFrame, keys: Sequence[str], value: str, weight: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_b`` (a value-ordered bucket number, about ``rows`` rows to a bucket) and ``_total`` (group weight)."""
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)], 5 * MAX_BUCKETS).alias("_all"),
        F.least(F.lit(MAX_BUCKETS), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("_n"), F.sum(weight).alias("_total"))
    # Every MAX_BUCKETS / n-th of the fine split points; a group of one bucket has none.
    chosen = F.when(F.col("_n") > 1, F.transform(
        F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.get("_all", (i * MAX_BUCKETS / F.col("_n")).cast("int") - 1)))
    cuts = cuts.select(*keys, F.coalesce(chosen, F.array().cast(f"array<{dict(df.dtypes)[value]}>")).alias("_cuts"), "_total")
    if keys:
        # Approximate points hang on the order in which sketches arrive. Bucket totals and running sums are separate passes and
        # must meet the same ones, so they are written; without keys ``attach`` reads them once.
        cuts = checkpointed(cuts)
    return (attach(df, cuts, keys)
            .withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
            .drop("_cuts"))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_cum`` (weight at or below this value), ``_tie`` (weight at it), ``_total`` and ``_b``."""
    keys = list(keys)
    b = bucketed(df, keys, value, weight, rows)
    per_bucket = b.groupBy(*keys, "_b").agg(F.sum(weight).alias("_bw"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    peers = Window.partitionBy(*keys, "_b", value)
    return (b.withColumn("_in", F.sum(weight).over(inside))
            .withColumn("_tie", F.sum(weight).over(peers))
            .join(offsets, [*keys, "_b"])
            .withColumn("_cum", F.col("_off") + F.col("_in"))
            .drop("_in", "_off"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mid-ranks (ties share the mean rank) of ``value`` within ``keys``, joined back to every row."""
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulative(hist, keys, value, "_n").select(
        *keys, value, (F.col("_cum") - (F.col("_tie") - 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def min_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Lowest rank of each tie block within ``keys``."""
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulative(hist, keys, value, "_n").select(
        *keys, value, (F.col("_cum") - F.col("_tie") + 1).alias(out))
    return df.join(ranks, [*keys, value], "left")


def quantile_name(column: str, p: float) -> str:
    return f"{column}_q{p * 100:g}".replace(".", "_")


def _usable(column: str) -> str:
    v = f"cast(`{column}` AS double)"
    return f"CASE WHEN NOT isnan({v}) AND abs({v}) < double('Infinity') THEN {v} END"


def quantiles(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact linear-interpolated quantiles in one pass: ``spec`` maps a column to its probabilities.

    One row per group; NULL and non-finite values are left out.  Output columns are named
    ``{column}_q{percent}``.
    """
    keys = list(keys)
    entries = ", ".join(f"named_struct('m', {i}, 'v', {_usable(c)})" for i, c in enumerate(spec))
    hist = (df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({entries})) AS (_m, _v)")
            .where("_v IS NOT NULL").groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n")))
    c = cumulative(hist, [*keys, "_m"], "_v", "_n")
    aggs: list[str] = []
    out: list[str] = []
    for i, (name, probs) in enumerate(spec.items()):
        aggs.append(f"max(CASE WHEN _m = {i} THEN _total END) AS _t{i}")
        for j, p in enumerate(probs):
            p = float(p)
            for tag, end in (("l", "floor"), ("h", "ceil")):
                aggs.append(f"min(CASE WHEN _m = {i} AND _cum > {end}({p}D * (_total - 1)) THEN _v END) "
                            f"AS _{tag}{i}_{j}")
            at = f"{p}D * (_t{i} - 1)"
            out.append(f"_l{i}_{j} + (_h{i}_{j} - _l{i}_{j}) * ({at} - floor({at})) "
                       f"AS `{quantile_name(name, p)}`")
    return (c.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
            .selectExpr(*[f"`{k}`" for k in keys], *out))


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians, named ``median_{column}``."""
    q = quantiles(df, keys, {c: [0.5] for c in columns})
    return q.select(*keys, *[F.col(quantile_name(c, 0.5)).alias(f"median_{c}") for c in columns])


def median_and_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median and unscaled median absolute deviation: two exact passes."""
    keys = list(keys)
    med = medians(df, keys, columns)
    dev = attach(df.select(*keys, *columns), med, keys).selectExpr(
        *[f"`{k}`" for k in keys], *[f"abs(`{c}` - `median_{c}`) AS `{c}`" for c in columns])
    mad = medians(dev, keys, columns).select(
        *keys, *[F.col(f"median_{c}").alias(f"mad_{c}") for c in columns])
    return attach(med, mad, keys)


def adjust_bh(df: DataFrame, keys: Sequence[str], p: str, out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg step-up adjustment within ``keys``; NULL p stays NULL and is not counted."""
    return adjust_weighted_bh(df, keys, p, None, out)


def adjust_weighted_bh(df: DataFrame, keys: Sequence[str], p: str, weight: str | None,
                       out: str) -> DataFrame:
    """Step-up adjustment with per-test weights (unit weights give plain Benjamini-Hochberg)."""
    keys = list(keys)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(w.alias("_w"))
    c = cumulative(hist, keys, p, "_w").withColumn("_raw", F.col(p) * F.col("_total") / F.col("_cum"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = (c.groupBy(*keys, "_b").agg(F.min("_raw").alias("_bmin"))
             .select(*keys, "_b", F.min("_bmin").over(above).alias("_later")))
    inside = (Window.partitionBy(*keys, "_b").orderBy(F.desc(p))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = (c.withColumn("_here", F.min("_raw").over(inside))
         .join(later, [*keys, "_b"])
         .select(*keys, p, F.least(F.lit(1.0), F.col("_here"), F.col("_later")).alias(out)))
    return df.join(q, [*keys, p], "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group.

    Spark limits each group inside every map task before the shuffle (the rank limit is pushed below
    the exchange), so a hot group sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_order(seed: int, c: str) -> Column:
    """A reproducible pseudo-random order: md5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))

"""Ingest checks and column introspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.order_stats import cumulative

GENE_FEATURES = ("Gene Expression", "GEX")


def validation_report(values: DataFrame, obs: DataFrame, var: DataFrame, value: str = "count") -> DataFrame:
    """One row per ingest check: ``(check, severity, value, verdict)``.  Every row of the input is read."""
    s = F.col("symbol")
    cased = s.rlike("[A-Za-z]") & (F.length(s) > 1)
    upper = cased & (F.upper(s) == s)
    title = cased & F.substring(s, 1, 1).rlike("[A-Z]") & ~upper
    names = var.agg(
        (F.count(s) - F.count_distinct(s)).cast("double").alias("dup"),
        F.avg(upper.cast("double")).alias("up"), F.avg(title.cast("double")).alias("title"),
        F.count_if(~F.col("feature_type").isin(*GENE_FEATURES)).cast("double").alias("other")).select(
        F.explode(F.array(
            _row("duplicate_symbols", F.when(F.col("dup") > 0, "warn").otherwise("ok"), F.col("dup"), F.lit("")),
            _row("organism_by_casing", F.lit("info"), F.col("up"),
                 F.when(F.col("up") > 0.6, "human")
                 .when((F.col("title") > 0.3) | (F.col("up") < 0.25), "mouse").otherwise("unknown")),
            _row("non_gene_features", F.when(F.col("other") > 0, "warn").otherwise("ok"), F.col("other"),
                 F.lit("")))).alias("r"))
    v = F.col(value).cast("double")
    state = values.agg(F.max(v).alias("hi"), F.min(v).alias("lo"),
                       F.max(F.abs(v - F.round(v))).alias("frac")).select(
        _row("matrix_state", F.lit("info"), F.col("hi"),
             F.when(F.col("hi").isNull(), "unknown").when(F.col("lo") < -0.01, "scaled")
             .when((F.col("frac") < 1e-6) & (F.col("hi") > 30), "counts")
             .when(F.col("hi") <= 30, "lognorm").otherwise("counts")).alias("r"))
    with_counts = values.where(v > 0).select("cell_id").distinct()
    empty = obs.join(with_counts, "cell_id", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        _row("zero_count_cells", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.col("n"), F.lit("")).alias("r"))
    return names.union(state).union(empty).select("r.*")


def _row(check: str, severity, value, verdict):
    return F.struct(F.lit(check).alias("check"), severity.alias("severity"), value.alias("value"),
                    verdict.alias("verdict"))


def require_organism(report: DataFrame, declared: str) -> None:
    """Refuse a declared organism that contradicts the casing of the gene symbols."""
    seen = report.where(F.col("check") == "organism_by_casing").first()["verdict"]
    if seen not in ("unknown", declared):
        raise ValueError(f"declared organism {declared!r}, but gene symbols look like {seen!r}")


def unique_names(var: DataFrame, order: str = "gene_id") -> DataFrame:
    """Second and later copies of a symbol get ``-1``, ``-2`` ... in the order of a numeric column."""
    one = var.withColumn("_one", F.lit(1))
    nth = cumulative(one, ["symbol"], order, "_one")
    name = F.when(F.col("_cum") == 1, F.col("symbol")).otherwise(
        F.concat("symbol", F.lit("-"), (F.col("_cum") - 1).cast("string")))
    return nth.select(*var.columns, name.alias("unique_symbol"))


def level_counts(obs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, level, n)`` over several columns in one pass; a missing value counts as level ``nan``."""
    return (obs.unpivot([], [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns],
                        "column", "level")
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))


def describe_columns(obs: DataFrame, columns: Sequence[str], max_levels: int = 30) -> DataFrame:
    """Cardinality of each column, whether it is constant, and its sorted levels when there are few."""
    per = level_counts(obs, columns)
    n = per.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    few = (per.join(n.where(F.col("n_levels") <= max_levels), "column").groupBy("column")
           .agg(F.array_join(F.sort_array(F.collect_list("level")), "|").alias("levels")))
    return n.join(few, "column", "left").select(
        "column", "n_levels", (F.col("n_levels") == 1).alias("constant"), "levels")


def groupable_columns(obs: DataFrame, columns: Sequence[str], max_levels: int = 30) -> DataFrame:
    """Columns with 2 to ``max_levels`` levels, fewest levels first, the more even first among equals."""
    per = level_counts(obs, columns)
    total = per.groupBy("column").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("n_levels"))
    p = F.col("n") / F.col("t")
    even = (per.join(total.where(F.col("n_levels").between(2, max_levels)), "column")
            .groupBy("column", "n_levels").agg((-F.sum(p * F.log(p))).alias("h"))
            .select("column", "n_levels", (F.col("h") / F.log(F.col("n_levels"))).alias("evenness")))
    rank = F.row_number().over(Window.orderBy("n_levels", F.desc(F.round("evenness", 9)), "column"))
    return even.withColumn("rank", rank)


def sample_level_columns(obs: DataFrame, columns: Sequence[str], sample: str = "sample",
                         max_levels: int = 50) -> DataFrame:
    """Columns constant within every sample; a missing value counts as a level."""
    long = obs.unpivot([F.col(sample)], [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)
                                         for c in columns if c != sample], "column", "level")
    pairs = long.groupBy("column", sample, "level").agg(F.count(F.lit(1)).alias("n"))
    inside = pairs.groupBy("column", sample).agg(F.count(F.lit(1)).alias("k"))
    varying = inside.where(F.col("k") > 1).select("column").distinct()
    levels = (pairs.select("column", "level").distinct().groupBy("column")
              .agg(F.count(F.lit(1)).alias("n_levels")))
    return levels.where(F.col("n_levels") <= max_levels).join(varying, "column", "left_anti")


def confounding_candidates(obs: DataFrame, columns: Sequence[str], batch: str,
                           max_levels: int = 12) -> DataFrame:
    """Low-cardinality columns worth checking a batch key against."""
    return groupable_columns(obs, columns, max_levels).where(F.col("column") != batch)

"""The tables behind figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio
from tallycell.functions.order_stats import quantiles, top_k


def dot_data(expression: DataFrame, per: str = "gene_id") -> DataFrame:
    """Mean expression scaled to [0, 1] per gene or per group; flat rows become zero."""
    w = Window.partitionBy(per)
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    return expression.withColumn("scaled", F.coalesce(ratio(F.col("mean") - lo, hi - lo), F.lit(0.0)))


def gene_order(dots: DataFrame, group: str = "label") -> DataFrame:
    """Genes blocked by the group where their scaled fraction peaks, strongest first inside a block."""
    best = dots.groupBy("gene_id").agg(F.min_by(group, F.struct(-F.round("fraction", 9), F.col(group))).alias("block"), F.max("fraction").alias("peak"))
    w = Window.partitionBy("block").orderBy(F.desc(F.round("peak", 9)), "gene_id")
    return best.select("gene_id", "block", F.row_number().over(w).alias("place"))


def heatmap(expression: DataFrame, per: str = "gene_id") -> DataFrame:
    """Group means as z-scores per gene or per group (sample deviation, zero taken as one)."""
    w = Window.partitionBy(per)
    sd = F.coalesce(F.stddev_samp("mean").over(w), F.lit(0.0))
    return expression.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))


def volcano(tested: DataFrame, keys: Sequence[str] = ("label",), fdr: float = 0.05, lfc: float = 0.5) -> DataFrame:
    sig = F.col("padj") < fdr
    return tested.withColumn("log_padj", -F.log10(F.greatest("padj", F.lit(1e-300)))).withColumn(
        "class", F.when(sig & (F.col("lfc") > lfc), "up").when(sig & (F.col("lfc") < -lfc), "down").otherwise("none"))


def volcano_labels(tested: DataFrame, keys: Sequence[str] = ("label",), n: int = 10, forced: Sequence = ()) -> DataFrame:
    """Genes to name: half by adjusted p, half by fold change, plus forced ones, without repeats."""
    keys = list(keys)
    by_p = top_k(tested, keys, [F.round("padj", 12), F.desc(F.round(F.abs("lfc"), 9)), F.col("gene_id")], n // 2)
    by_l = top_k(tested, keys, [F.desc(F.round(F.abs("lfc"), 9)), F.col("gene_id")], n - n // 2)
    out = by_p.select(*keys, "gene_id").union(by_l.select(*keys, "gene_id"))
    if forced:
        out = out.union(tested.where(F.col("gene_id").isin(list(forced))).select(*keys, "gene_id"))
    return out.distinct()


def state_space(cells: DataFrame, x: str, y: str, group: str = "label") -> DataFrame:
    """Centroid, covariance and ellipse axes of each group in two dimensions."""
    m = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
                                 F.var_samp(x).alias("vxx"), F.var_samp(y).alias("vyy"), F.covar_samp(x, y).alias("vxy"))
    half, gap = (F.col("vxx") + F.col("vyy")) / 2, (F.col("vxx") - F.col("vyy")) / 2
    root = F.sqrt(gap * gap + F.col("vxy") * F.col("vxy"))
    return m.select("*", F.sqrt(F.greatest(F.lit(0.0), half + root)).alias("major"), F.sqrt(F.greatest(F.lit(0.0), half - root)).alias("minor"),
                    F.degrees(F.atan2(2 * F.col("vxy"), F.col("vxx") - F.col("vyy")) / 2).alias("angle"))


def colour_limits(scores: DataFrame, centre: float = 0.0) -> DataFrame:
    """99th percentile of the distance from the centre, per score."""
    v = scores.select("set_name", F.abs(F.col("score") - centre).alias("a"))
    return quantiles(v, ["set_name"], {"a": [0.99]}).select("set_name", F.col("a_q99").alias("colour_limit"))


def facet_counts(obs: DataFrame, facets: Sequence[str], highlight: str, value: str) -> DataFrame:
    """Cells per facet, and how many of them are highlighted."""
    return obs.groupBy(*facets).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(highlight) == value).alias("n_highlight"))

"""Ligand-receptor scores between labels and their comparison across contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio
from tallycell.functions.order_stats import cumulative, top_k


def population_floor(obs: DataFrame, label: str = "label", context: Sequence[str] = (), min_cells: int = 30) -> tuple[DataFrame, DataFrame]:
    """Labels large enough to compare per context (with their sizes), and those left out."""
    n = obs.groupBy(*context, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_cells"))
    return n.where(F.col("n_cells") >= min_cells), n.where(F.col("n_cells") < min_cells)


def gene_by_label(lognorm: DataFrame, obs: DataFrame, genes: DataFrame, sizes: DataFrame, label: str = "label",
                  context: Sequence[str] = ()) -> DataFrame:
    """Mean and expressing fraction of the needed genes per label, over all its cells."""
    cells = obs.select("cell_id", F.col(label).alias("label"), *context)
    return (lognorm.join(genes, "gene_id", "left_semi").join(cells, "cell_id").groupBy(*context, "label", "gene_id")
            .agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k")).join(sizes, [*context, "label"])
            .select(*context, "label", "gene_id", (F.col("s") / F.col("n_cells")).alias("mean"), (F.col("k") / F.col("n_cells")).alias("frac")))


def pair_scores(stats: DataFrame, pairs: DataFrame, context: Sequence[str] = (), expr_prop: float = 0.1) -> DataFrame:
    """Scores of every ligand-receptor pair for every ordered pair of labels.

    ``pairs`` is ``(pair_id, side, gene_id)`` with sides ``ligand`` and ``receptor``; a complex is as strong as
    its weakest subunit, and all its subunits must be seen in ``expr_prop`` of the cells.
    """
    need = pairs.groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("units"))
    sides = (pairs.join(stats, "gene_id").groupBy(*context, "label", "pair_id", "side")
             .agg(F.min("mean").alias("mean"), F.min("frac").alias("frac"), F.count(F.lit(1)).alias("seen"))
             .join(need, ["pair_id", "side"]).where((F.col("seen") == F.col("units")) & (F.col("frac") >= expr_prop)))

    def side(name: str, end: str, short: str) -> DataFrame:
        return sides.where(F.col("side") == name).select(*context, "pair_id", F.col("label").alias(end), F.col("mean").alias(f"{short}_mean"))

    both = side("ligand", "source", "l").join(side("receptor", "target", "r"), [*context, "pair_id"])
    l, r = F.col("l_mean"), F.col("r_mean")
    whole = Window.partitionBy(*context, "pair_id")
    return both.select(*context, "source", "target", "pair_id", ((l + r) / 2).alias("lr_means"), (l * r).alias("expr_prod"),
                       ratio(l * r, F.sum(l * r).over(whole)).alias("specific_weight"))


def consensus_rank(scores: DataFrame, columns: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """Mean normalised rank over several scores, best first."""
    whole = Window.partitionBy(*context)
    ranks = [F.rank().over(whole.orderBy(F.desc(F.round(c, 9)))) / F.count(F.lit(1)).over(whole) for c in columns]
    total = ranks[0]
    for x in ranks[1:]:
        total = total + x
    return scores.withColumn("consensus", total / len(columns))


def differential(a: DataFrame, b: DataFrame, value: str = "lr_means", specificity: str | None = None, cutoff: float = 0.05,
                 top_n: int = 20) -> DataFrame:
    """Largest changes of a score between two contexts, up and down."""
    keys = ["source", "target", "pair_id"]
    pick = [value] + ([specificity] if specificity else [])
    m = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in pick]).join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in pick]), keys)
    m = m.withColumn("delta", F.col(f"{value}_a") - F.col(f"{value}_b"))
    up, down = F.col("delta") > 0, F.col("delta") < 0
    if specificity:
        up, down = up & (F.col(f"{specificity}_a") <= cutoff), down & (F.col(f"{specificity}_b") <= cutoff)
    sided = m.withColumn("direction", F.when(up, "up").when(down, "down")).where("direction IS NOT NULL")
    return top_k(sided, ["direction"], [F.desc(F.round(F.abs("delta"), 9)), *[F.col(k) for k in keys]], top_n)


def dot_data(scores: DataFrame, value: str = "lr_means", sources: Sequence[str] = (), targets: Sequence[str] = (), top_n: int = 30) -> DataFrame:
    out = scores
    if sources:
        out = out.where(F.col("source").isin(*sources))
    if targets:
        out = out.where(F.col("target").isin(*targets))
    return out.orderBy(F.desc(F.round(value, 9)), "source", "target", "pair_id").limit(top_n)


def robust_means(values: DataFrame, obs: DataFrame, sizes: DataFrame, label: str = "label", context: Sequence[str] = ()) -> DataFrame:
    """``(q1 + 2 * median + q3) / 4`` of each gene per label, zeros included.

    Only non-zero entries are ordered; a quantile that falls into the block of zeros is zero.
    """
    keys = [*context, "label", "gene_id"]
    cells = obs.select("cell_id", F.col(label).alias("label"), *context)
    hist = values.join(cells, "cell_id").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n"))
    c = cumulative(hist, keys, "x", "_n").join(sizes, [*context, "label"])
    zeros = F.col("n_cells") - F.col("_total")

    def at(pos):
        inside = F.min(F.when(F.col("_cum") + zeros > pos, F.col("x")))
        return F.when(F.max(pos) < F.max(zeros), 0.0).otherwise(inside)

    def quantile(p: float):
        pos = F.lit(p) * (F.col("n_cells") - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        return lo + (hi - lo) * F.max(pos - F.floor(pos))

    return c.groupBy(*keys).agg(((quantile(0.25) + 2 * quantile(0.5) + quantile(0.75)) / 4).alias("level"))


def pathway_flow(levels: DataFrame, pairs: DataFrame, context: Sequence[str] = (), half: float = 0.5) -> DataFrame:
    """Information flow per pathway: Hill-transformed ligand-receptor products summed over label pairs.

    ``pairs`` is ``(pathway, pair_id, side, gene_id)``; complexes use the geometric mean of their subunits.
    """
    need = pairs.groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("units"))
    sides = (pairs.join(levels.where("level > 0"), "gene_id").groupBy(*context, "label", "pathway", "pair_id", "side")
             .agg(F.exp(F.avg(F.log("level"))).alias("v"), F.count(F.lit(1)).alias("seen"))
             .join(need, ["pair_id", "side"]).where(F.col("seen") == F.col("units")))
    lig = sides.where("side = 'ligand'").select(*context, "pathway", "pair_id", F.col("label").alias("source"), F.col("v").alias("l"))
    rec = sides.where("side = 'receptor'").select(*context, "pathway", "pair_id", F.col("label").alias("target"), F.col("v").alias("r"))
    both = lig.join(rec, [*context, "pathway", "pair_id"])
    lr = F.col("l") * F.col("r")
    return both.groupBy(*context, "pathway").agg(F.sum(lr / (half + lr)).alias("flow"))


def compare_flow(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flow of each pathway in two splits with its log ratio; a pathway absent from one side counts as zero."""
    m = a.select("pathway", F.col("flow").alias("flow_a")).join(b.select("pathway", F.col("flow").alias("flow_b")), "pathway", "full").fillna(0.0)
    return m.withColumn("log2_ratio", F.log2((F.col("flow_a") + 1e-9) / (F.col("flow_b") + 1e-9)))

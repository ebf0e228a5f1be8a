"""Atlas summaries, ortholog mapping and label transfer."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.functions.order_stats import hash_order
from tallycell.knowledge import fixed


def inventory(obs: DataFrame, by: Sequence[str], dataset: str) -> DataFrame:
    """Cells and datasets per combination of attributes."""
    return obs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct(dataset).alias("n_datasets"))


def group_expression(lognorm: DataFrame, obs: DataFrame, genes: DataFrame, group: str = "label") -> DataFrame:
    """Mean and expressing fraction of given genes per group, zeros included: a full gene-by-group table."""
    sizes = obs.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))
    levels = sizes.agg(F.collect_list(F.struct(group, "n_cells"))).toDF("l").scalar()
    sums = (lognorm.join(genes.select("gene_id"), "gene_id", "left_semi").join(obs.select("cell_id", group), "cell_id")
            .groupBy("gene_id", group).agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k")))
    grid = genes.select("gene_id").withColumn("l", levels).select("gene_id", F.explode("l").alias("l")).select("gene_id", "l.*")
    return grid.join(sums, ["gene_id", group], "left").select(
        "gene_id", group, "n_cells", (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean"),
        (F.coalesce("k", F.lit(0)) / F.col("n_cells")).alias("fraction"))


def downsample(obs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``n`` cells."""
    return obs.orderBy(hash_order(seed, "cell_id"), "cell_id").limit(n)


class Orthologs(NamedTuple):
    mapped: DataFrame
    ambiguous: DataFrame
    unmapped: DataFrame


def map_orthologs(genes: DataFrame, table: DataFrame) -> Orthologs:
    """First hit per gene in the order of the table; ``table`` is ``(source, target, ord)``."""
    hits = table.groupBy("source").agg(F.min_by("target", "ord").alias("target"), F.count_distinct("target").alias("n_targets"))
    joined = genes.select(F.col("gene").alias("source")).distinct().join(hits, "source", "left")
    return Orthologs(joined.where("target IS NOT NULL").select("source", "target"),
                     joined.where("n_targets > 1").select("source", "n_targets"), joined.where("target IS NULL").select("source"))


def vote_labels(neighbours: DataFrame, labels: DataFrame, low: float = 0.6) -> DataFrame:
    """Majority label among reference neighbours, ties alphabetically, with the vote share as confidence."""
    n = (neighbours.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n")))
    return n.groupBy(F.col("src").alias("cell_id")).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"), (F.max("n") / F.sum("n")).alias("confidence")).withColumn(
        "low_confidence", F.col("confidence") < low)


def confusion(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.join(labels.select("cell_id", "label"), "cell_id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def domain_shift(obs: DataFrame, columns: Sequence[str], tokens: Sequence[str] = tuple(fixed.INJURY_TOKENS)) -> DataFrame:
    """Metadata values that say the tissue is not healthy: ``(column, value)``; every level is checked."""
    long = obs.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "value").distinct()
    return long.where(F.lower("value").rlike("|".join(tokens)))


def cluster_vote(predicted: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every cell takes the commonest prediction of its cluster."""
    n = predicted.join(clusters, "cell_id").groupBy("cluster", "predicted").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("cluster").agg(F.min_by("predicted", F.struct(-F.col("n"), F.col("predicted"))).alias("majority"))
    return clusters.join(best, "cluster").select("cell_id", "majority")


def marker_lookup(gene_sets: DataFrame, name: str) -> DataFrame:
    """Sets whose plain name equals the query, else those containing it or contained in it."""
    def plain(c):
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    q, s = plain(F.lit(name)), plain(F.col("set_name"))
    names = gene_sets.select("set_name").distinct().select("set_name", F.when(s == q, 0).when(s.contains(q) | q.contains(s), 1).alias("kind"))
    best = names.agg(F.min("kind")).toDF("k").scalar()
    return gene_sets.join(names.where(F.col("kind") == best), "set_name").select("set_name", "gene_id")


def train_classifier(vectors: DataFrame, labels: DataFrame, max_iter: int = 50, reg: float = 1e-3):
    """Multinomial classifier of cells by label; returns the model, label names and the class sizes."""
    data = vectors.join(labels.select("cell_id", "label"), "cell_id")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    model = LogisticRegression(family="multinomial", labelCol="y", maxIter=max_iter, regParam=reg).fit(index.transform(data))
    sizes = data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("thin", F.col("n") < 20)
    return model, list(index.labels), sizes


def classify(model, names: Sequence[str], vectors: DataFrame) -> DataFrame:
    """Predicted label and its probability for every cell."""
    p = vector_to_array("probability")
    return model.transform(vectors).select(
        "cell_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int")).alias("predicted"), F.array_max(p).alias("confidence"))

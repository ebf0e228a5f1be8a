"""Putting samples together and grafting raw counts onto processed cells."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycell.knowledge import fixed


class Assembled(NamedTuple):
    """One dataset from many samples, plus the number of genes each sample contributed."""

    counts: DataFrame
    obs: DataFrame
    gene_counts: DataFrame


def build_multisample(samples: Mapping[str, DataFrame], attributes: DataFrame) -> Assembled:
    """Concatenate per-sample count tables ``(barcode, gene_id, count)``.

    Cell ids become ``barcode_sample``; a gene missing from a sample is an implicit zero there.
    ``attributes`` has one row per sample with a ``sample`` column; canonical column names are applied.
    """
    tagged = [df.select(F.concat_ws("_", F.col("barcode").cast("string"), F.lit(name)).alias("cell_id"),
                        F.lit(name).alias("sample"), "gene_id", "count") for name, df in samples.items()]
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    named = attributes.select(*[F.col(c).alias(c if c == "sample" else fixed.COLUMN_RENAMES.get(c.lower(), c))
                                for c in attributes.columns])
    obs = allrows.select("cell_id", "sample").distinct().join(named, "sample", "left")
    per = (allrows.select("sample", "gene_id").distinct().groupBy("sample")
           .agg(F.count(F.lit(1)).alias("n_genes")))
    return Assembled(allrows.select("cell_id", "gene_id", "count"), obs, per)


def _barcode_keys(cell: Column) -> list[tuple[str, Column]]:
    no_suffix = F.regexp_replace(cell, "-[^-]*$", "")
    no_prefix = F.regexp_replace(cell, "^[^_]*_", "")
    return [("exact", cell), ("no_suffix", no_suffix), ("no_prefix", no_prefix),
            ("neither", F.regexp_replace(no_prefix, "-[^-]*$", ""))]


class Alignment(NamedTuple):
    """Pairs ``(cell_id, source_id)`` under the best strategy, and all strategies with their matches."""

    pairs: DataFrame
    strategies: DataFrame


def align_barcodes(target: DataFrame, source: DataFrame) -> Alignment:
    """Match cells under four spellings of the barcode.

    A spelling that is not unique on both sides is not used; the one with most matches wins, the plainer
    one among equals.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("ord"), F.lit(s).alias("strategy"), k.alias("key"))
                for i, (s, k) in enumerate(_barcode_keys(F.col("cell_id").cast("string")))]
        return df.select(F.col("cell_id").alias(name), F.explode(F.array(*keys)).alias("k")).select(
            name, "k.ord", "k.strategy", "k.key")

    t, s = keyed(target, "cell_id"), keyed(source, "source_id")

    def repeated(df: DataFrame) -> DataFrame:
        return (df.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                .select("strategy").distinct())

    usable = t.join(repeated(t), "strategy", "left_anti").join(repeated(s), "strategy", "left_anti")
    matched = usable.join(s.select("strategy", "key", "source_id"), ["strategy", "key"])
    tally = matched.groupBy("ord", "strategy").agg(F.count(F.lit(1)).alias("n_matched"))
    best = tally.agg(F.max_by("strategy", F.struct(F.col("n_matched"), -F.col("ord")))).toDF("s").scalar()
    return Alignment(matched.where(F.col("strategy") == best).select("cell_id", "source_id"), tally)


class Grafted(NamedTuple):
    """Counts on the target cells and genes, and a one-row report to accept or refuse them by."""

    counts: DataFrame
    report: DataFrame


def attach_counts(target: DataFrame, var: DataFrame, source_counts: DataFrame) -> Grafted:
    """Graft raw counts from another matrix onto ``target`` cells and ``var`` genes."""
    pairs = align_barcodes(target, source_counts.select("cell_id").distinct()).pairs
    counts = (source_counts.withColumnRenamed("cell_id", "source_id").join(pairs, "source_id")
              .join(var.select("gene_id"), "gene_id", "left_semi").select("cell_id", "gene_id", "count"))
    genes = var.select("gene_id").join(source_counts.select("gene_id"), "gene_id", "left_semi")
    v = F.col("count").cast("double")
    report = counts.agg(F.max(F.abs(v - F.round(v))).alias("max_fraction")).select(
        pairs.agg(F.count(F.lit(1))).scalar().alias("n_matched"),
        target.agg(F.count(F.lit(1))).scalar().alias("n_cells"),
        genes.agg(F.count(F.lit(1))).scalar().alias("n_genes_matched"),
        var.agg(F.count(F.lit(1))).scalar().alias("n_genes"), "max_fraction")
    return Grafted(counts, report)


def check_graft(report: DataFrame) -> None:
    """Refuse a source without matching cells, with under half the genes, or with fractional values."""
    row = report.first()
    if not row["n_matched"]:
        raise ValueError("no barcode matches under any spelling")
    if row["n_genes_matched"] < 0.5 * row["n_genes"]:
        raise ValueError("under half of the genes are present in the source")
    if (row["max_fraction"] or 0.0) > 1e-6:
        raise ValueError("the source does not hold integer counts")

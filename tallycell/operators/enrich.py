"""Over-representation, preranked enrichment and regulator activity on result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallycell.functions.numeric import hypergeometric_upper_tail
from tallycell.functions.order_stats import adjust_bh, cumulative, top_k
from tallycell.session import checkpointed


def clean_term(c: Column) -> Column:
    """Cut at the first bracket, turn underscores into spaces, start with a capital."""
    s = F.regexp_replace(F.trim(F.split_part(c, F.lit("("), F.lit(1))), "_", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000))


class Terms(NamedTuple):
    kept: DataFrame
    dropped: DataFrame


def exclude_terms(results: DataFrame, exclude: Sequence[str], column: str = "term") -> Terms:
    """Split off the terms that contain one of the excluded phrases, ignoring case."""
    low = F.lower(column)
    hit = F.lit(False)
    for e in exclude:
        hit = hit | low.contains(e.lower())
    return Terms(results.where(~hit), results.where(hit))


def directions(tested: DataFrame, fdr: float = 0.05, lfc: float = 0.5) -> DataFrame:
    """Significant genes with their direction."""
    d = F.when(F.col("lfc") > lfc, "up").when(F.col("lfc") < -lfc, "down")
    return tested.where(F.col("padj") < fdr).withColumn("direction", d).where("direction IS NOT NULL")


def over_representation(significant: DataFrame, gene_sets: DataFrame, background: int = 15000, min_genes: int = 5,
                        keys: Sequence[str] = ("label",), top_n: int | None = None) -> DataFrame:
    """Hypergeometric test of every set for each (keys, direction) with enough significant genes."""
    by = [*keys, "direction"]
    picked = significant.select(*by, "gene_id").distinct()
    sizes = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_list")).where(F.col("n_list") >= min_genes)
    members = gene_sets.select("set_name", "gene_id").distinct()
    set_sizes = members.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_set"))
    hits = (picked.join(members, "gene_id").groupBy(*by, "set_name").agg(F.count(F.lit(1)).alias("overlap"))
            .join(sizes, by).join(set_sizes, "set_name"))
    k, n, m = F.col("overlap"), F.col("n_list"), F.col("n_set")
    total = F.greatest(F.lit(background).cast("bigint"), n + m - k)
    p = hypergeometric_upper_tail(k, n, m, total)
    fold = (k / n) / (m / F.lit(float(background)))
    out = adjust_bh(checkpointed(hits.withColumn("pval", p).withColumn("fold", fold)), by, "pval", "padj")
    if top_n is None:
        return out
    return top_k(out, by, [F.round("padj", 12), F.round("pval", 12), F.col("set_name")], top_n)



def ranking_metric(tested: DataFrame, by: str = "stat") -> DataFrame:
    """Add ``metric``: a statistic, the fold change, or signed ``-log10 padj`` (floored at 1e-300)."""
    if by == "signed_logp":
        m = F.signum("lfc") * -F.log10(F.greatest(F.col("padj"), F.lit(1e-300)))
    else:
        m = F.col(by)
    return tested.withColumn("metric", m.cast("double")).where("metric IS NOT NULL AND NOT isnan(metric)")


def _positions(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Place of each gene in the descending order of the metric (ties by gene), counted in buckets."""
    c = cumulative(ranked.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("_n")), keys, "metric", "_n").select(
        *keys, "metric", (F.col("_total") - F.col("_cum")).alias("_above"), F.col("_total").alias("n_ranked"))
    tie = Window.partitionBy(*keys, "metric").orderBy("gene_id")
    return (ranked.join(c, [*keys, "metric"])
            .withColumn("pos", F.col("_above") + F.row_number().over(tie)).drop("_above"))


def enrichment_scores(positions: DataFrame, members: DataFrame, keys: Sequence[str], by: Sequence[str],
                      weight: float = 1.0) -> DataFrame:
    """Extreme deviation of the running sum for each set.

    The curve only turns at members, so it is evaluated just before and at each of them: the running sum
    needs the members' positions, not a scan over all genes.
    """
    hits = positions.join(members, "gene_id").withColumn("_w", F.pow(F.abs("metric"), F.lit(weight)))
    part = [*keys, *by]
    tot = hits.groupBy(*part).agg(F.sum("_w").alias("_tw"), F.count(F.lit(1)).alias("n_hits"))
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = hits.join(tot, part).withColumn("_cw", F.sum("_w").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    miss = (F.col("pos") - F.col("_k")) / (F.col("n_ranked") - F.col("n_hits"))
    tw = F.when(F.col("_tw") > 0, F.col("_tw")).otherwise(1.0)
    at, before = F.col("_cw") / tw - miss, (F.col("_cw") - F.col("_w")) / tw - miss
    ext = curve.where(F.col("n_ranked") > F.col("n_hits")).groupBy(*part, "n_hits").agg(
        F.max(at).alias("hi"), F.min(before).alias("lo"))
    return ext.select(*part, "n_hits", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def observed_enrichment(ranked: DataFrame, gene_sets: DataFrame, keys: Sequence[str] = ("label",),
                        min_size: int = 10, max_size: int = 500) -> DataFrame:
    members = gene_sets.select("set_name", "gene_id").distinct()
    es = enrichment_scores(_positions(ranked, list(keys)), members, keys, ["set_name"])
    return es.where(F.col("n_hits").between(min_size, max_size))


def _distinct_positions(draws: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``n_hits`` of the places 1..n for every (set, permutation), all sets of places equally likely: for j over the last n_hits
    places, a place up to j is drawn, and j itself is taken where that one is taken already."""
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("drawn")
            for i in range(len(drawn)):  # a row at a time: its places are many
                first = batch.column("first")[i].as_py()
                taken: dict[int, None] = {}
                for j, place in enumerate(drawn[i].values.tolist() if drawn[i].is_valid else [], first):
                    taken[j if place in taken else place] = None
                own = [pa.repeat(batch.column(c)[i], len(taken)) for c in (*keys, "set_name", "perm")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(taken), pa.int64())], [*keys, "set_name", "perm", "pos"])

    def place(j: Column) -> Column:
        text = F.concat_ws(":", F.lit(seed), "set_name", "perm", j)
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), j) + 1

    first = F.col("n") - F.col("n_hits") + 1
    drawn = draws.select(*keys, "set_name", "perm", first.alias("first"), F.transform(F.sequence(first, F.col("n")), place).alias("drawn"))
    out = StructType([*[f for f in drawn.schema.fields if f.name in (*keys, "set_name", "perm")], StructField("pos", LongType())])
    return drawn.mapInArrow(chosen, out)


def preranked_enrichment(ranked: DataFrame, gene_sets: DataFrame, n_perm: int = 1000, keys: Sequence[str] = ("label",),
                         min_size: int = 10, max_size: int = 500, seed: int = 0) -> DataFrame:
    """Normalised enrichment with permutation p and BH.

    A permutation draws positions without replacement by md5 of (seed, set, permutation, place), so a permuted
    set is as large as the set it is compared with; each running sum costs the size of the set, and permutations
    spread over the cluster.  FDR is the step-up adjustment of p.
    """
    keys = list(keys)
    pos = checkpointed(_positions(ranked, keys))
    obs = checkpointed(observed_enrichment(ranked, gene_sets, keys, min_size, max_size))
    draws = obs.select(*keys, "set_name", "n_hits", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
    sizes = pos.groupBy(*keys).agg(F.max("n_ranked").cast("bigint").alias("n"))
    placed = _distinct_positions(draws.join(sizes, keys), keys, seed)
    fake = placed.join(pos.select(*keys, "pos", "gene_id", "metric", "n_ranked"), [*keys, "pos"])
    part = [*keys, "set_name", "perm"]
    fake = fake.withColumn("_w", F.abs("metric"))
    tot = fake.groupBy(*part).agg(F.sum("_w").alias("_tw"), F.count(F.lit(1)).alias("n_hits"))
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = fake.join(tot, part).withColumn("_cw", F.sum("_w").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    miss = (F.col("pos") - F.col("_k")) / F.greatest(F.col("n_ranked") - F.col("n_hits"), F.lit(1))
    tw = F.when(F.col("_tw") > 0, F.col("_tw")).otherwise(1.0)
    ext = curve.groupBy(*part).agg(F.max(F.col("_cw") / tw - miss).alias("hi"),
                                   F.min((F.col("_cw") - F.col("_w")) / tw - miss).alias("lo"))
    null = ext.select(*part, F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("e"))
    es = F.col("es")
    same = F.signum("e") == F.signum(es)
    out = obs.join(null, [*keys, "set_name"]).groupBy(*keys, "set_name", "n_hits", "es").agg(
        F.avg(F.when(same, F.abs("e"))).alias("scale"), F.count_if(same & (F.abs("e") >= F.abs(es))).alias("beyond"),
        F.count_if(same).alias("n_same"))
    scored = out.select(*keys, "set_name", "n_hits", "es", (es / F.col("scale")).alias("nes"),
                        ((F.col("beyond") + 1) / (F.col("n_same") + 1)).alias("pval"))
    return adjust_bh(checkpointed(scored), keys, "pval", "fdr")


def regulator_activity(tested: DataFrame, regulons: DataFrame, stat: str = "score",
                       keys: Sequence[str] = ("label",), min_targets: int = 5) -> DataFrame:
    """t value of the slope of gene statistics on signed regulon weights (zero for other genes)."""
    keys = list(keys)
    y = F.col(stat)
    whole = tested.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    x = F.col("weight")
    per = (tested.join(regulons.select("set_name", "gene_id", "weight"), "gene_id").groupBy(*keys, "set_name")
           .agg(F.count(F.lit(1)).alias("n_targets"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
                F.sum(x * y).alias("sxy")).where(F.col("n_targets") >= min_targets).join(whole, keys))
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = cxy / F.sqrt(cxx * cyy)
    return per.where((cxx > 0) & (cyy > 0)).select(
        *keys, "set_name", "n_targets", (rho * F.sqrt((n - 2) / (1 - rho * rho))).alias("activity"))


def libraries_for(catalogue: DataFrame, question: str, organism: str) -> DataFrame:
    """Libraries recommended for a question that do not name the other organism."""
    n = F.lower("library")
    fits = F.when(n.contains("mouse"), F.lit(organism == "mouse")).when(
        n.contains("human"), F.lit(organism == "human")).otherwise(True)
    return catalogue.where((F.col("question") == question) & fits)


def tile_data(results: DataFrame, order: Sequence[str] = ("down", "up"), keys: Sequence[str] = ("label",)) -> DataFrame:
    """Figure data: ``-log10 padj``, direction order, and a display position per key."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("direction"))
    shown = results.withColumn("log_padj", -F.log10(F.greatest(F.col("padj"), F.lit(1e-300)))).withColumn("dir_ord", pos.cast("int"))
    w = Window.partitionBy(*keys).orderBy("dir_ord", F.desc(F.round("log_padj", 9)), "set_name")
    return shown.withColumn("display", F.row_number().over(w))

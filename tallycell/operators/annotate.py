"""Label proposals, label bookkeeping and the contamination audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.order_stats import attach, quantiles, top_k
from tallycell.knowledge import fixed
from tallycell.session import checkpointed, stored


def lineage_profile(means: DataFrame, group: str = "label", n_top: int = 3) -> DataFrame:
    """Best sets of each group and the entropy of its score profile (softmax of z-scores), with a flag."""
    centre = means.groupBy(group).agg(F.avg("mean_score").alias("m"), F.stddev_samp("mean_score").alias("sd"),
                                      F.count(F.lit(1)).alias("k"), F.first("n_cells").alias("n_cells"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("sd"))
    e = means.select(group, "set_name", "mean_score").join(centre, group).withColumn(
        "e", F.exp((F.col("mean_score") - F.col("m")) / sd))
    total = e.groupBy(group).agg(F.sum("e").alias("t"))
    p = F.greatest(F.col("e") / F.col("t"), F.lit(1e-12))
    ent = e.join(total, group).groupBy(group, "n_cells", "k").agg((-F.sum(p * F.log(p))).alias("h")).select(
        group, "n_cells", (F.col("h") / F.log(F.greatest("k", F.lit(2)))).alias("entropy"))
    best = top_k(means, [group], [F.desc(F.round("mean_score", 9)), F.col("set_name")], n_top)
    names = best.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("rank", "set_name"))), lambda s: s["set_name"]), "|").alias("top"))
    return ent.join(names, group).withColumn("ambiguous", F.col("entropy") > 0.85)


def propose_labels(tested: DataFrame, gene_sets: DataFrame, means: DataFrame, group: str = "label",
                   top_n: int = 50) -> DataFrame:
    """A set for each group from marker votes (0.6) and min-max module score (0.4), with confidence."""
    top = top_k(tested.select(group, "gene_id", "padj", "score"), [group],
                [F.round("padj", 12), F.desc(F.round("score", 9)), F.col("gene_id")], top_n)
    votes = (top.join(gene_sets.select("set_name", "gene_id").distinct(), "gene_id")
             .groupBy(group, "set_name").agg(F.count(F.lit(1)).alias("votes")))
    most = votes.groupBy(group).agg(F.max("votes").alias("most"))
    span = means.groupBy(group).agg(F.min("mean_score").alias("lo"), F.max("mean_score").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    part = F.coalesce(F.col("votes") / F.col("most"), F.lit(0.0))
    combined = F.round(0.6 * part + 0.4 * (F.col("mean_score") - F.col("lo")) / width, 3)
    scored = (means.join(votes, [group, "set_name"], "left").join(most, group, "left").join(span, group)
              .select(group, "set_name", "n_cells", combined.alias("combined")))
    best = top_k(scored, [group], [F.desc("combined"), F.col("set_name")], 2)

    def at(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    two = best.groupBy(group, "n_cells").agg(at(1, "set_name").alias("proposed_label"), at(1, "combined").alias("first"),
                                             at(2, "set_name").alias("runner_up"), at(2, "combined").alias("second"))
    margin = F.col("first") - F.coalesce("second", F.lit(0.0))
    out = two.select(group, "n_cells", "proposed_label", "runner_up", margin.alias("margin"),
                     F.least(F.lit(0.97), F.greatest(F.lit(0.0), 0.35 + 1.6 * margin)).alias("confidence"))
    used = out.groupBy("proposed_label").agg(F.count(F.lit(1)).alias("n_used"))
    return out.join(used, "proposed_label").withColumn("repeated", F.col("n_used") > 1).drop("n_used")


class Labelled(NamedTuple):
    """Cells with labels, clusters without one (must be empty), mapping rows no cell uses, level order."""

    obs: DataFrame
    unmapped: DataFrame
    unused: DataFrame
    levels: DataFrame


def apply_labels(obs: DataFrame, mapping: Mapping[str, str], cluster: str, name: str = "cell_type") -> Labelled:
    table = obs.sparkSession.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(mapping.items())], f"{cluster} string, {name} string, ord int")
    seen = obs.select(cluster).distinct()
    levels = table.groupBy(F.col(name).alias("level")).agg(F.min("ord").alias("ord"))
    return Labelled(obs.join(table.drop("ord"), cluster, "left"), seen.join(table, cluster, "left_anti"),
                    table.select(cluster).join(seen, cluster, "left_anti"), levels)


def discard_share(obs: DataFrame, label: str, limit: float = 15.0) -> DataFrame:
    """Share of cells whose label is a discard bucket; one row with a warning flag."""
    words = "|".join(w.replace("/", "\\/") for w in fixed.DISCARD_WORDS)
    per = obs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    hit = F.lower(label).rlike(words)
    return per.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_discarded"), F.sum("n").alias("n_cells")).select(
        "n_discarded", "n_cells", (100.0 * F.col("n_discarded") / F.col("n_cells")).alias("pct")).withColumn(
        "warn", F.col("pct") >= limit)


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def match_label(labels: DataFrame, candidates: Sequence[str], column: str = "label",
                aliases: Sequence[tuple[str, str]] = tuple(fixed.LABEL_ALIASES)) -> DataFrame:
    """The candidate a free-text label stands for: equal spelling, then containment, then an abbreviation.

    Candidates and aliases are short fixed lists, so matching is one expression without any join.
    """
    text = _plain(F.col(column))
    names = F.array(*[F.struct(F.lit(c).alias("name"), _plain(F.lit(c)).alias("plain")) for c in candidates])
    equal = F.filter(names, lambda s: s["plain"] == text)
    inside = F.filter(names, lambda s: (s["plain"] != "") & (text.contains(s["plain"]) | s["plain"].contains(text)))
    known = set(candidates)
    short = F.coalesce(*[F.when(text.contains(a), F.lit(full)) for a, full in aliases if full in known],
                       F.lit(None).cast("string"))
    return labels.withColumn("matched", F.coalesce(F.get(equal, 0)["name"], F.get(inside, 0)["name"], short))


def expresses(scores: DataFrame, usable: DataFrame) -> DataFrame:
    """Pairs of a cell and one of the usable sets with at least two detected genes and a positive module score.

    ``scores`` carries both numbers (see :func:`tallycell.operators.score.module_scores`), so no second pass over the counts is made.
    """
    return (scores.where((F.col("n_det") >= 2) & (F.col("score") > 0)).join(F.broadcast(usable.select("set_name").distinct()), "set_name", "left_semi")
            .select("cell_id", "set_name"))


def codetection_excess(expressed: DataFrame, obs: DataFrame, pairs: DataFrame, label: str = "label",
                       keep_above: float = 0.02) -> DataFrame:
    """Joint detection of exclusive programs per label, beyond the rate over all cells.

    A cell's programs are gathered into one array (never longer than the list of sets), so a pair is an
    array test rather than a self-join.
    """
    sets = expressed.groupBy("cell_id").agg(F.collect_set("set_name").alias("sets"))
    wanted = pairs.agg(F.collect_list(F.struct("a", "b"))).toDF("p").scalar()
    both = (sets.withColumn("wanted", wanted)
            .withColumn("p", F.explode(F.filter("wanted", lambda p: F.array_contains("sets", p["a"])
                                                & F.array_contains("sets", p["b"]))))
            .select("cell_id", "p.a", "p.b"))
    sizes = obs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_all"))
    per = both.join(obs.select("cell_id", label), "cell_id").groupBy(label, "a", "b").agg(F.count(F.lit(1)).alias("k"))
    base = per.groupBy("a", "b").agg(F.sum("k").alias("k_all"))
    rate, over = F.col("k") / F.col("n"), F.col("k_all") / F.col("n_all")
    return attach(per.join(base, ["a", "b"]).join(sizes, label), whole, []).select(
        label, "a", "b", rate.alias("rate"), over.alias("base"), (rate - over).alias("excess")).where(
        F.col("excess") > keep_above)


def foreign_programs(scores: DataFrame, obs: DataFrame, native: DataFrame, label: str = "label",
                     keep_above: float = 0.05) -> DataFrame:
    """Share of a label's cells in which another set outscores the label's own.

    ``scores`` must hold every cell and set, ``native`` the pairs ``(label, set_name)``. Scores are sums whose last digits hang on the
    order of addition: they are compared at nine places.
    """
    own = native.select(F.col(label), F.col("set_name").alias("native"))
    with_label = scores.join(obs.select("cell_id", label), "cell_id").join(F.broadcast(own), label)
    mine = F.max(F.when(F.col("set_name") == F.col("native"), F.col("score"))).over(Window.partitionBy("cell_id", "native"))
    return (with_label.withColumn("own_score", mine).where((F.col("set_name") != F.col("native")) & F.col("own_score").isNotNull())
            .groupBy(label, "set_name").agg(F.avg((F.round("score", 9) > F.round("own_score", 9)).cast("double")).alias("fraction"))
            .where(F.col("fraction") > keep_above))


def ambient_correlation(lognorm: DataFrame, counts: DataFrame, obs: DataFrame, label: str = "label",
                        n_genes: int = 20) -> DataFrame:
    """Correlation of each label's mean profile with the global one over the most abundant genes."""
    top = (counts.groupBy("gene_id").agg(F.sum("count").alias("t")).orderBy(F.desc("t"), "gene_id").limit(n_genes)
           .select("gene_id"))
    sizes = obs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_all"))
    x = lognorm.join(top, "gene_id", "left_semi").join(obs.select("cell_id", label), "cell_id")
    per = x.groupBy("gene_id", label).agg(F.sum("x").alias("s"))
    overall = per.groupBy("gene_id").agg(F.sum("s").alias("s_all"))
    names = sizes.agg(F.collect_list(F.struct(label, "n"))).toDF("l").scalar()
    grid = overall.select("gene_id", "s_all", F.explode(names).alias("l")).select("gene_id", "s_all", "l.*")
    full = attach(grid.join(per, ["gene_id", label], "left").fillna(0.0, ["s"]), whole, [])
    return full.groupBy(label).agg(F.coalesce(
        F.corr(F.col("s") / F.col("n"), F.col("s_all") / F.col("n_all")), F.lit(0.0)).alias("ambient_r"))


def label_composition(obs: DataFrame, label: str = "label", sample: str = "sample",
                      called: str = "predicted_doublet") -> DataFrame:
    """Size, doublet share and dominant sample of each label."""
    per = obs.groupBy(label, sample).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(called)).alias("d"))
    return per.groupBy(label).agg(
        F.sum("n").alias("n_cells"), (F.sum("d") / F.sum("n")).alias("doublet_fraction"),
        F.min_by(sample, F.struct(-F.col("n"), F.col(sample))).alias("dominant_sample"),
        (F.max("n") / F.sum("n")).alias("dominant_sample_frac"))


def contamination_audit(lognorm: DataFrame, counts: DataFrame, obs: DataFrame, var: DataFrame, gene_sets: DataFrame,
                        weights: DataFrame, scores: DataFrame, pairs: DataFrame, native: DataFrame,
                        label: str = "label", min_cells: int = 20) -> DataFrame:
    """One row per label: contamination score, the likely cause and what to do about it. ``scores`` carry ``n_det``."""
    from tallycell.operators.qc import present_sets
    from tallycell.operators.score import every_cell
    usable = present_sets(gene_sets, var, 3)
    excess = codetection_excess(expresses(scores, usable), obs, pairs, label)
    full = stored(every_cell(scores, obs, weights), "scores")
    foreign = checkpointed(foreign_programs(full, obs, native, label))
    worst = F.min_by("set_name", F.struct(-F.round("fraction", 3), F.col("set_name")))
    dominant = foreign.groupBy(label).agg(F.max("fraction").alias("max_foreign"), worst.alias("dominant"))
    values = (full.join(obs.select("cell_id", label), "cell_id")
              .join(dominant.select(label, F.col("dominant").alias("set_name")), [label, "set_name"]))
    quart = quantiles(values, [label], {"score": [0.25, 0.75]})
    spread = values.groupBy(label).agg(F.stddev_pop("score").alias("sd")).join(quart, label).select(
        label, F.when(F.col("sd") > 0, (F.col("score_q75") - F.col("score_q25")) / (F.col("sd") + 1e-9))
        .otherwise(0.0).alias("bimodality"))
    table = (label_composition(obs, label).where(F.col("n_cells") >= min_cells)
             .join(ambient_correlation(lognorm, counts, obs, label), label, "left")
             .join(excess.groupBy(label).agg(F.max(F.round("excess", 3)).alias("max_excess")), label, "left")
             .join(dominant, label, "left").join(spread, label, "left")
             .fillna(0.0, ["max_excess", "max_foreign", "bimodality", "ambient_r"]))
    f, x, d, b = F.col("max_foreign"), F.col("max_excess"), F.col("doublet_fraction"), F.col("bimodality")
    cause = (F.when((F.col("ambient_r") > 0.9) & (x < 0.10) & (f < 0.25), "ambient")
             .when((d > 0.25) & (f > 0.2), "doublet")
             .when((f > 0.35) & (b > 1.2) & (d < 0.25), "mixed_cluster")
             .when((f > 0.10) & (f <= 0.35) & (b <= 1.2), "true_biology").otherwise("clean"))
    action = (F.when(cause == "ambient", "estimate ambient signal").when(cause == "doublet", "test doublet enrichment by cluster")
              .when(cause == "mixed_cluster", "subcluster and label anew").when(cause == "true_biology", "keep and note the shared program")
              .otherwise("none"))
    return table.withColumn("contamination_score", 0.5 * f + 0.35 * x + 0.15 * F.least(d * 3, F.lit(1.0))) \
        .withColumn("likely_cause", cause).withColumn("recommended_action", action)


def refinement_plan(audit: DataFrame, threshold: float = 0.2, round_no: int = 1, base_resolution: float = 0.4,
                    step: float = 0.2, label: str = "label") -> DataFrame:
    """Actions for the labels above the threshold: ``(label, cause, action, resolution)``.

    Mixed clusters get a sub-clustering at a resolution that grows with the round, then new labels;
    doublets are tested by cluster; ambient signal is estimated rather than hidden.
    """
    res = F.lit(base_resolution + (round_no - 1) * step)
    none = F.lit(None).cast("double")

    def act(name: str, r: Column) -> Column:
        return F.struct(F.lit(name).alias("action"), r.alias("resolution"))

    c = F.col("likely_cause")
    actions = (F.when(c == "ambient", F.array(act("estimate_ambient", none)))
               .when(c == "doublet", F.array(act("test_doublet_enrichment", none)))
               .when(c == "mixed_cluster", F.array(act("subcluster", res), act("propose_labels", res))))
    return (audit.where(F.col("contamination_score") > threshold)
            .select(label, c.alias("cause"), F.explode(actions).alias("a")).select(label, "cause", "a.*"))

"""Questions to the recorded steps, datasets, annotations and notes of a project."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.knowledge import fixed
from tallycell.session import checkpointed


def lineage(datasets: DataFrame, start: object) -> DataFrame:
    """Ancestors and descendants of a dataset, to the end of the chain: ``(dataset_id, relation, depth)``.

    Each pass follows one generation from the frontier with a semi-sized join and leaves out what was seen
    before, so that a cycle ends it like any last generation.
    """
    edges = datasets.select(F.col("dataset_id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent"))
    out = edges.where(F.col("id") == str(start)).select("id", F.lit("self").alias("relation"), F.lit(0).alias("depth"))
    for relation, a, b in (("ancestor", "id", "parent"), ("descendant", "parent", "id")):
        frontier = edges.where(F.col("id") == str(start)).select("id")
        seen = frontier
        for depth in itertools.count(1):
            step = edges.join(frontier.withColumnRenamed("id", a), a).where(F.col(b).isNotNull()).select(F.col(b).alias("id")).distinct()
            frontier = checkpointed(step.join(seen, "id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
            out = out.union(frontier.select("id", F.lit(relation).alias("relation"), F.lit(depth).alias("depth")))
            if depth % 16 == 0:  # long chains: keep the plans short
                seen, out = checkpointed(seen), checkpointed(out)
    return out.withColumnRenamed("id", "dataset_id")


def resolve(datasets: DataFrame, ref: str) -> DataFrame:
    """A handle as it is, else the newest dataset with that label."""
    exact = F.col("dataset_id").cast("string") == ref
    return datasets.where(exact | (F.col("label") == ref)).orderBy(F.desc(exact), F.desc("created_at"), F.desc("dataset_id")).limit(1)


def find_datasets(datasets: DataFrame, op: str, params: dict[str, str]) -> DataFrame:
    """Datasets made by an operation with the given parameter values."""
    out = datasets.where(F.col("op") == op)
    for k, v in params.items():
        out = out.where(F.get_json_object("params_json", f"$.{k}") == str(v))
    return out


def current_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations nothing has superseded."""
    gone = annotations.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("annotation_id"))
    return annotations.join(gone, "annotation_id", "left_anti")


def scoped_parameter(parameters: DataFrame, name: str, scope: str) -> DataFrame:
    """The newest value in the exact scope, else the global one."""
    rank = F.when(F.col("scope") == scope, 0).when(F.col("scope") == "global", 1)
    return parameters.where((F.col("name") == name) & rank.isNotNull()).orderBy(rank, F.desc("created_at"), F.desc("param_id")).limit(1)


def query_words(text: str) -> list[str]:
    return sorted({w for w in re.findall(r"[a-z0-9]{3,}", text.lower()) if w not in fixed.STOPWORDS})


def keyword_search(rows: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Rows ``(kind, id, title, body)`` ranked by the share of distinct query words they contain."""
    words = query_words(text)
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    if words:
        hits = F.lit(0)
        for w in words:
            hits = hits + hay.contains(w).cast("int")
        score = F.round(hits / len(words), 3)
    else:
        score = hay.contains(text.lower().strip()).cast("double")
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "kind", "id").limit(limit)


def repeated_failures(steps: DataFrame, last: int = 6) -> DataFrame:
    """Failures folded by tool and the first 120 characters of the error; the latest ones first."""
    bad = steps.where(~F.col("ok")).groupBy("tool", F.substring(F.coalesce("error", F.lit("")), 1, 120).alias("error"))
    return bad.agg(F.count(F.lit(1)).alias("n"), F.max("step_id").alias("last_step"), F.min("step_id").alias("first_step")).orderBy(
        F.desc("first_step")).limit(last).drop("first_step")


def missing_stages(steps: DataFrame, stages: Sequence[tuple[str, str]], n: int = 3) -> DataFrame:
    """The first stages, in order, of which no successful step is recorded; stages are (name, tool pattern)."""
    table = steps.sparkSession.createDataFrame([(i + 1, s, p) for i, (s, p) in enumerate(stages)], "ord int, stage string, pattern string")
    ran = [F.max(F.when(F.col("ok"), F.col("tool").rlike(p)).otherwise(False).cast("int")).alias(f"s{i}") for i, (_, p) in enumerate(stages)]
    flags = steps.agg(*ran).select(F.array(*[f"s{i}" for i in range(len(stages))])).toDF("f").scalar()
    return table.withColumn("done", F.coalesce(F.get(flags, F.col("ord") - 1), F.lit(0))).where("done = 0").orderBy("ord").limit(n).select("ord", "stage")


def timeline(steps: DataFrame, limit: int = 50) -> DataFrame:
    return steps.select("step_id", "tool", "ok", (F.col("ended_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")).alias("seconds")).orderBy(F.desc("step_id")).limit(limit)


def project_summary(steps: DataFrame, datasets: DataFrame) -> DataFrame:
    """Step and dataset counts per project."""
    s = steps.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_steps"))
    d = datasets.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_datasets"))
    return s.join(d, "project_id", "full").fillna(0, ["n_steps", "n_datasets"])


def append_steps(steps: DataFrame, path: str) -> None:
    """Add rows to the append-only step log."""
    steps.write.mode("append").parquet(path)

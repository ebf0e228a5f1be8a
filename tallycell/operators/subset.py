"""Extracting labels, dropping clusters, and mapping sub-labels back."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Extracted(NamedTuple):
    obs: DataFrame
    counts: DataFrame


def extract_labels(obs: DataFrame, counts: DataFrame, label: str, keep: Sequence[str],
                   drop_columns: Sequence[str] = ()) -> Extracted:
    """Cells of the given labels with raw counts; inherited cluster columns become ``parent_*``."""
    chosen = obs.where(F.col(label).isin(list(keep)))
    names = [F.col(c).alias(f"parent_{c}" if re.match(r"^(leiden|louvain)([_.]|$)", c, re.IGNORECASE) else c)
             for c in chosen.columns if c not in drop_columns]
    return Extracted(chosen.select(*names), counts.join(chosen.select("cell_id"), "cell_id", "left_semi"))


def require_cells(obs: DataFrame, at_least: int = 50) -> None:
    """Refuse a subset that is too small to analyse."""
    n = obs.limit(at_least).count()
    if n < at_least:
        raise ValueError(f"only {n} cells; at least {at_least} are needed")


class Dropped(NamedTuple):
    """Remaining cells, and one decision row: what was dropped, how many cells, why, and a size warning."""

    obs: DataFrame
    decision: DataFrame


def drop_clusters(obs: DataFrame, cluster: str, drop: Sequence[str], reason: str, confirm: bool = False) -> Dropped:
    if not reason.strip():
        raise ValueError("a reason is required")
    if not confirm:
        raise ValueError("pass confirm=True to drop clusters")
    gone = F.col(cluster).isin(list(drop))
    decision = obs.agg(F.count_if(gone).alias("n_dropped"), F.count(F.lit(1)).alias("n_before")).select(
        F.lit(",".join(sorted(drop))).alias("clusters"), F.lit(reason).alias("reason"), "n_dropped", "n_before",
        (F.col("n_dropped") / F.col("n_before") > 0.6).alias("warn"))
    return Dropped(obs.where(~F.coalesce(gone, F.lit(False))), decision)


class MappedBack(NamedTuple):
    """Parent cells with the new label column, and the match rate of the sub-labels."""

    obs: DataFrame
    match: DataFrame


def map_back(parent: DataFrame, sub: DataFrame, label: str, new: str, fallback: str) -> MappedBack:
    """Sub-labels by cell; other cells keep the value of ``fallback``."""
    names = sub.select("cell_id", F.col(label).alias("_new"))
    out = parent.join(names, "cell_id", "left").withColumn(
        new, F.coalesce("_new", F.col(fallback).cast("string"))).drop("_new")
    hit = names.join(parent.select("cell_id", F.lit(1).alias("_h")), "cell_id", "left").agg(
        F.count("_h").alias("n_matched"), F.count(F.lit(1)).alias("n_sub")).withColumn(
        "rate", F.col("n_matched") / F.col("n_sub"))
    return MappedBack(out, hit)


def check_match(match: DataFrame, force: bool = False, at_least: float = 0.95) -> None:
    rate = match.first()["rate"]
    if rate < at_least and not force:
        raise ValueError(f"only {rate:.1%} of the sub-labels match a parent cell")

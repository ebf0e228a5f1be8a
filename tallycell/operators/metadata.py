"""Sample metadata: annotation, name parsing, level orders, composites and modal values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import first_number, natural_key
from tallycell.knowledge import fixed


class Annotated(NamedTuple):
    """Cells with sample attributes, samples the table misses, and table rows no cell uses."""

    obs: DataFrame
    uncovered: DataFrame
    extra: DataFrame


def annotate_samples(obs: DataFrame, table: DataFrame, sample: str = "sample",
                     renames: Mapping[str, str] = fixed.COLUMN_RENAMES) -> Annotated:
    """Attach a per-sample table; the caller must refuse the result when ``uncovered`` has rows."""
    new = [c for c in table.columns if c != sample]
    renamed = table.select(sample, *[F.col(c).alias(renames.get(c.lower(), c)) for c in new])
    keep = [c for c in obs.columns if c == sample or c not in renamed.columns]
    return Annotated(
        obs.select(*keep).join(renamed, sample, "left"),
        obs.select(sample).distinct().join(table, sample, "left_anti"),
        table.select(sample).join(obs.select(sample), sample, "left_anti"))


def parse_names(names: DataFrame, pattern: str, column: str = "sample") -> DataFrame:
    """Named groups of a pattern as columns; a name it does not match gives NULLs and ``matched`` false."""
    groups = re.findall(r"\(\?P<(\w+)>", pattern)
    java = pattern.replace("(?P<", "(?<")
    hit = F.col(column).rlike(java)
    return names.select(*names.columns, hit.alias("matched"), *[
        F.when(hit, F.regexp_extract(column, java, i + 1)).alias(g) for i, g in enumerate(groups)])


def levels_by_number(obs: DataFrame, column: str) -> DataFrame:
    """Distinct levels ordered by the first number inside them (``D7`` before ``D14``), others last."""
    n = first_number(column)
    w = Window.orderBy(n.isNull(), n, column)
    return obs.select(column).distinct().select(F.col(column).alias("level"), F.row_number().over(w).alias("ord"))


def explicit_order(obs: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """A given level order; levels of the data it misses come back with a NULL position."""
    given = F.array(*[F.lit(v) for v in order])
    pos = F.array_position(given, F.col(column))
    return obs.select(column).distinct().select(
        F.col(column).alias("level"), F.when(pos > 0, pos.cast("int")).alias("ord"))


def natural_order(obs: DataFrame, column: str) -> DataFrame:
    """Distinct levels in natural alphanumeric order."""
    w = Window.orderBy(natural_key(column), column)
    return obs.select(column).distinct().select(F.col(column).alias("level"), F.row_number().over(w).alias("ord"))


class Composite(NamedTuple):
    """Cells with the joined column, and its level order."""

    obs: DataFrame
    levels: DataFrame


def composite_column(obs: DataFrame, columns: Sequence[str], name: str, sep: str = "_") -> Composite:
    """Join columns with a separator; levels follow the number-aware order of each component in turn."""
    out = obs.withColumn(name, F.concat_ws(sep, *columns))
    order = []
    for c in columns:
        n = first_number(c)
        order += [n.isNull(), n, F.col(c)]
    levels = out.select(name, *columns).distinct().select(
        F.col(name).alias("level"), F.row_number().over(Window.orderBy(*order)).alias("ord"))
    return Composite(out, levels)


def modal_values(obs: DataFrame, columns: Sequence[str], sample: str = "sample") -> DataFrame:
    """The commonest value of each column per sample, the smallest among equals; one row per sample."""
    long = obs.unpivot([F.col(sample)], [F.col(c).cast("string").alias(c) for c in columns], "column", "level")
    n = long.where("level IS NOT NULL").groupBy(sample, "column", "level").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("level", F.struct(-F.col("n"), F.col("level")))
    mode = n.groupBy(sample, "column").agg(best.alias("level"))
    return mode.groupBy(sample).agg(*[
        F.max(F.when(F.col("column") == c, F.col("level"))).alias(c) for c in columns])

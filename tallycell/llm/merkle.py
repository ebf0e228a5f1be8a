"""Merkle manifest of a dataset: a tree for each language, a tree over their roots, and a checked proof for every row.

The nodes of a level are rows (tree, idx). Every level is joined with itself on computed sibling indices: idx XOR 1 in a binary
tree, otherwise the other slots of the run of ``arity``. So each node gets its siblings, and the rows in slot zero then emit the
parents. A tree that is down to one node passes it on unchanged. Indices come from a range-partitioned sort with the counts of
each partition added up, so no task sees a whole language and a language of any size spreads over all tasks.

Proofs are put together from the top: STRATUM levels at a time, the at most ARM leaves below one node form a group of bounded
size, which looks the siblings up and passes them down with what lies above.

Nulls: a null field is hashed as ``-``; a null lang is a language of its own and comes first; rows without doc_id come first and
are never tampered with. Rows of one doc_id follow each other by leaf digest (equal rows are interchangeable). An empty text is
``0:``. A text is hashed whole, inside the row. Empty tables give empty results; other columns than the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.llm.common import written

#: Leaves below the node at the top of a group of levels.
ARM = 1024
HEX = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_TYPES = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row's five fields, each with its byte count; ``changed`` replaces fields."""
    return F.sha2(F.concat(*[_field((changed or {}).get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, tampered: the digest, and the digest of the tampered row where tampering changes it (else null)."""
    plain = docs.select(*[F.col(c).cast(t).alias(c) for c, t in _TYPES.items()])
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = leaf_digest({"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    return plain.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(hit, more).alias("tampered"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with idx, its place in ``group`` by ``order`` (nulls first), and n, the size of the group.

    Sorted by ranges and written with a number for each row; the places where groups begin in the partitions are counts that
    are added up by group.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_group")
    runs = (rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
            .withColumn("_base", F.sum("_rows").over(inside.orderBy("_run")) - F.col("_rows"))
            .withColumn("n", F.sum("_rows").over(inside)))
    joined = rows.join(runs, rows[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_run")))
    return joined.select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_first")).alias("idx"), "n")


def _slots(arity: int) -> Column:
    return F.col("idx") % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, n, idx, digest, ...) with siblings: the digests of the rest of the run, left to right, joined; null where
    the node is the only one left of its tree."""
    joined = nodes
    for shift in range(1, arity):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - _slots(arity) + (_slots(arity) + shift) % arity
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_shift{shift}"))
        joined = (joined.withColumn("_place", place)
                  .join(other, (F.col("tree") == F.col("_tree")) & (F.col("_place") == F.col("_idx")), "left").drop("_tree", "_idx", "_place"))
    # In slot order: the runs' last slots come round to the shifts that wrapped.
    found = F.concat(*[F.concat(*[F.when((_slots(arity) + shift) % arity == slot, F.coalesce(f"_shift{shift}", F.lit(""))).otherwise("")
                                  for shift in range(1, arity)]) for slot in range(arity)])
    return joined.select(*nodes.columns, F.when(F.col("n") > 1, found).alias("siblings"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level, emitted by the rows in slot zero."""
    up = F.when(F.col("n") > 1, F.sha2(F.concat("digest", "siblings"), 256)).otherwise(F.col("digest"))
    return level.filter(_slots(arity) == 0).select("tree", F.floor((F.col("n") + arity - 1) / arity).cast("long").alias("n"),
                                                   F.floor(F.col("idx") / arity).cast("long").alias("idx"), up.alias("digest"))


def build(nodes: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all trees with siblings, lowest first, and the roots (tree, digest).

    ``nodes``: tree, n, idx, digest and columns that only the lowest level keeps.
    """
    if arity < 2:
        raise ValueError("a node needs at least two slots")
    levels: list[DataFrame] = []
    width = 2
    while width > 1:
        levels.append(written(with_siblings(nodes, arity), f"merkle-{len(levels)}"))
        nodes = parents(levels[-1], arity)
        if len(levels) == 1:
            width = levels[0].agg(F.max("n")).first()[0] or 1
        width = -(-width // arity)
    return levels, written(nodes.select("tree", "digest"), "merkle-roots")


def _stratum(arity: int) -> int:
    height = 1
    while arity ** (height + 1) <= ARM:
        height += 1
    return height


def _handed_down(arity: int, height: int, passed: list[str]) -> Callable:
    """Rows of groups to rows of their lowest nodes: tree, idx, path and the ``passed`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                level, idx, siblings = (one.column(c).to_pylist()[0] for c in ("level", "place", "siblings"))
                above = one.column("above").to_pylist()[0]
                table = dict(zip(zip(level, idx, strict=True), siblings, strict=True))
                low = [i for i, x in enumerate(level) if x == 0]
                paths = [[table[s, idx[i] // arity ** s] for s in range(height) if (s, idx[i] // arity ** s) in table] + above for i in low]
                own = [one.column(c).flatten().take(pa.array(low, pa.int64())) if c.startswith("own_") else
                       pa.concat_arrays([one.column(c)] * len(low)) if low else one.column(c).slice(0, 0) for c in passed]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.column("tree").to_pylist() * len(low), pa.int64()), pa.array([idx[i] for i in low], pa.int64()),
                     pa.array(paths, pa.list_(pa.string())), *own], ["tree", "idx", "path", *passed])
    return run


def paths(levels: list[DataFrame], seeds: DataFrame, arity: int = 2) -> DataFrame:
    """tree, idx, path of every node of the lowest level, with its further columns (named own_...) and those of ``seeds``.

    path: the siblings of each level, lowest first (null: no run at this level). ``seeds``: tree and columns to hand to all its nodes.
    """
    told = [c for c in seeds.columns if c != "tree"]
    height = _stratum(arity)
    kept = [c for c in levels[0].columns if c.startswith("own_")]
    top = -(-len(levels) // height) - 1
    above = seeds.select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("path"), *told)
    for j in range(top, -1, -1):
        part = levels[j * height:(j + 1) * height]
        own = kept if j == 0 else []
        rows = [df.select("tree", F.floor(F.col("idx") / arity ** (height - s)).cast("long").alias("block"), F.struct(
            F.lit(s).alias("level"), F.col("idx").alias("place"), "siblings",
            *[(F.col(c) if s == 0 else F.lit(None).cast(levels[0].schema[c].dataType)).alias(c) for c in own]).alias("node")) for s, df in enumerate(part)]
        groups = reduce(DataFrame.unionByName, rows).groupBy("tree", "block").agg(F.collect_list("node").alias("node"))
        joined = groups.join(above.withColumnRenamed("idx", "block").withColumnRenamed("path", "above"), ["tree", "block"])
        flat = joined.select("tree", "block", "above", *told, *[F.col("node")[c].alias(c) for c in ["level", "place", "siblings", *own]])
        types = ["tree long", "idx long", "path array<string>", *[f"`{c}` {seeds.schema[c].dataType.simpleString()}" for c in told],
                 *[f"`{c}` {levels[0].schema[c].dataType.simpleString()}" for c in own]]
        above = flat.mapInArrow(_handed_down(arity, height, [*told, *own]), ", ".join(types))
        if j:
            above = written(above, "merkle-paths")
    return above


def fold(digest: str, idx: int, path: list[str | None], arity: int = 2) -> str:
    """The root that a leaf at ``idx`` and its siblings give."""
    for siblings in path:
        if siblings is not None:
            cut = idx % arity * HEX
            digest = hashlib.sha256((siblings[:cut] + digest + siblings[cut:]).encode()).hexdigest()
        idx //= arity
    return digest


def _checked(arity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("idx", "path", "top_idx", "top_path", "own_leaf", "own_tampered")]
            proofs, folded = [], []
            for idx, path, top_idx, top_path, leaf, tampered in zip(*columns, strict=True):
                proofs.append(hashlib.sha256("".join(x for x in (*path, *top_path) if x is not None).encode()).hexdigest())
                folded.append(fold(fold(tampered or leaf, idx, path, arity), top_idx, top_path, arity))
            yield pa.RecordBatch.from_arrays([batch.column("own_doc_id"), batch.column("own_leaf"), batch.column("subroot"), batch.column("root"),
                                              pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                                             ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
    return run


def manifest(docs: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of the language trees (own_doc_id, own_leaf, own_tampered at the lowest) and, for each language's tree,
    tree, subroot, top_idx, top_path, root: its root, its place and siblings in the tree over all, and the root of that."""
    placed = numbered(written(leaves(docs), "merkle-leaves"), "lang", ["doc_id", "leaf"])
    langs = numbered(placed.filter("idx = 0").select("lang", F.lit(0).cast("long").alias("all")), "all", ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("idx").alias("tree"))
    # idx runs from zero in every language, so the joined side has one row for each language.
    nodes = placed.join(langs, placed["lang"].eqNullSafe(F.col("_lang"))).select(
        "tree", "n", "idx", F.col("leaf").alias("digest"), F.col("doc_id").alias("own_doc_id"), F.col("leaf").alias("own_leaf"), F.col("tampered").alias("own_tampered"))
    levels, subroots = build(nodes, arity)
    size = subroots.groupBy().agg(F.count("*").alias("n"))
    tops = subroots.crossJoin(F.broadcast(size)).select(F.lit(0).cast("long").alias("tree"), "n", F.col("tree").alias("idx"), "digest", F.col("digest").alias("own_digest"))
    top_levels, root = build(tops, arity)
    seeds = paths(top_levels, root.withColumnRenamed("digest", "root"), arity).select(
        F.col("idx").alias("tree"), F.col("own_digest").alias("subroot"), F.col("idx").alias("top_idx"), F.col("path").alias("top_path"), "root")
    return levels, written(seeds, "merkle-seeds")


def verified(docs: DataFrame, arity: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``."""
    levels, seeds = manifest(docs, arity)
    checked = paths(levels, seeds, arity).mapInArrow(
        _checked(arity), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(heights: tuple[int, int] = (24, 10)) -> str:
    """DuckDB twin of the registered query, its levels written out: up to 2^24 rows a language, 2^10 languages."""
    def enc(x: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    row = " || ".join(enc(c) for c in FIELDS)
    changed = " || ".join(enc("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), list_value(0::BIGINT, 0, 0, 0, 0, 0, 0, 0)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)) + i)))")
    out = [f"r AS (SELECT doc_id, lang, sha256({row}) AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN sha256({changed}) END AS tampered FROM documents)",
           "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r)",
           "a0 AS MATERIALIZED (SELECT lang AS g, i, n, leaf AS d FROM l)"]

    def tree(a: str, height: int) -> list[str]:
        return [f"{a}{h + 1} AS MATERIALIZED (SELECT g, x.i // 2 AS i, (max(n) + 1) // 2 AS n, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY x.i)) END AS d "
                f"FROM {a}{h} x GROUP BY g, x.i // 2)" for h in range(height)]

    def walk(p: str, a: str, height: int) -> list[str]:
        return [f"{p}{h + 1} AS MATERIALIZED (SELECT doc_id, p.lang, leaf, subroot, p.g, p.i // 2 AS i, (p.n + 1) // 2 AS n, proof || CASE WHEN p.n = 1 THEN '' ELSE coalesce(s.d, '') END AS proof, "
                f"CASE WHEN p.n = 1 THEN f WHEN p.i % 2 = 0 THEN sha256(f || coalesce(s.d, '')) ELSE sha256(s.d || f) END AS f "
                f"FROM {p}{h} p LEFT JOIN {a}{h} s ON s.g IS NOT DISTINCT FROM p.g AND s.i = xor(p.i, 1))" for h in range(height)]
    low, high = heights
    out += tree("a", low)
    out += [f"b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS lang FROM a{low})", *tree("b", high)]
    out += [f"p0 AS (SELECT l.doc_id, l.lang, l.leaf, s.d AS subroot, l.lang AS g, l.i, l.n, '' AS proof, coalesce(l.tampered, l.leaf) AS f FROM l JOIN a{low} s ON s.g IS NOT DISTINCT FROM l.lang)",
            *walk("p", "a", low)]
    out += [f"q0 AS (SELECT doc_id, p.lang, leaf, subroot, 0 AS g, b.i, b.n, proof, f FROM p{low} p JOIN b0 b ON b.lang IS NOT DISTINCT FROM p.lang)", *walk("q", "b", high)]
    return ("WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, b{high}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{high}.d AS verified FROM q{high}, b{high}")


SQL = _sql()

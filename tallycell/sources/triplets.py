"""MatrixMarket directories, bundles under deterministic handles, and result tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycell.functions.order_stats import cumulative


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of a names file, or of a folder of parts in the order of their names, with their 1-based number.

    The reader packs blocks of files into partitions in any order, but keeps the lines of one block together
    and in order; so lines are counted by (file, block start), and the blocks' totals, one row each, are
    accumulated.
    """
    block = ["_file", "_start"]
    rows = (spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
            .withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, block).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("ix"), F.col("value").alias(name))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``(gene_ix, cell_ix, count)`` of a MatrixMarket file; comments and the size line are skipped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    # The size line: the first data line of the first file in path order.
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                          F.monotonically_increasing_id().alias("id"))
    first = placed.agg(F.min_by("value", F.struct("path", "start", "id"))).first()[0]
    entries = lines.select(F.get(parts, 0).cast("bigint").alias("gene_ix"), F.get(parts, 1).cast("bigint").alias("cell_ix"),
                           F.get(parts, 2).cast("double").alias("count"), "value")
    # The size line is the first data line; an equal entry line would be an out-of-range duplicate.
    n_rows, n_cols, nnz = (int(v) for v in first.split())
    size = (F.col("gene_ix") == n_rows) & (F.col("cell_ix") == n_cols) & (F.col("count") == nnz) & (F.col("value") == first)
    kept = entries.where(~size).drop("value")
    seen, broken = kept.agg(F.count(F.lit(1)), F.count_if((F.col("count") != F.floor("count")) | (F.col("count") < 0) | F.col("count").isNull())).first()
    if seen != nnz:
        raise ValueError(f"{path}: expected {nnz} entries")
    if broken:
        raise ValueError(f"{path}: {broken} entries are not whole numbers; counts are needed")
    return kept.where("count > 0")


def load_10x(spark: SparkSession, directory: str, sample: str, suffix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A 10x directory as (counts, cells, genes); symbols are made unique and the sample is set."""
    features = _numbered(spark, f"{directory}/features.tsv{suffix}", "line")
    cols = F.split("line", "\t")
    genes = features.select("ix", F.get(cols, 0).alias("accession"), F.coalesce(F.get(cols, 1), F.get(cols, 0)).alias("symbol"),
                            F.coalesce(F.get(cols, 2), F.lit("Gene Expression")).alias("feature_type")).withColumn("_one", F.lit(1))
    nth = cumulative(genes, ["symbol"], "ix", "_one")
    genes = nth.select("ix", "accession", "symbol", "feature_type", F.when(F.col("_cum") == 1, F.col("symbol")).otherwise(
        F.concat("symbol", F.lit("-"), (F.col("_cum") - 1).cast("string"))).alias("gene_id"))
    cells = _numbered(spark, f"{directory}/barcodes.tsv{suffix}", "cell_id")
    counts = (read_matrix(spark, f"{directory}/matrix.mtx{suffix}")
              .join(genes.select(F.col("ix").alias("gene_ix"), "gene_id"), "gene_ix")
              .join(cells.select(F.col("ix").alias("cell_ix"), "cell_id"), "cell_ix").select("cell_id", "gene_id", F.col("count").cast("bigint").alias("count")))
    return counts, cells.select("cell_id", F.lit(sample).alias("sample")), genes.drop("ix")


def load_export(spark: SparkSession, directory: str, embeddings: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The plain export layout: counts, metadata in barcode order, and embeddings as arrays."""
    genes, cells = _numbered(spark, f"{directory}/genes.txt", "gene_id"), _numbered(spark, f"{directory}/barcodes.txt", "cell_id")
    counts = (read_matrix(spark, f"{directory}/matrix.mtx").join(genes.withColumnRenamed("ix", "gene_ix"), "gene_ix")
              .join(cells.withColumnRenamed("ix", "cell_ix"), "cell_ix").select("cell_id", "gene_id", F.col("count").cast("bigint").alias("count")))
    obs = cells.select("cell_id").join(spark.read.csv(f"{directory}/metadata.csv", header=True), "cell_id", "left")
    emb = {}
    for name in embeddings:
        table = spark.read.csv(f"{directory}/reducedDim_{name}.csv", header=True)
        dims = [c for c in table.columns if c != "cell_id"]
        emb[name] = cells.select("cell_id").join(table.select("cell_id", F.array(*[F.col(c).cast("double") for c in dims]).alias("v")), "cell_id", "left")
    return counts, obs, emb


def write_export(counts: DataFrame, obs: DataFrame, var: DataFrame, directory: str) -> None:
    """Write counts, names and metadata in the layout that :func:`load_export` reads: every file is a folder of sorted parts."""
    def indexed(df: DataFrame, c: str, ix: str, name: str) -> DataFrame:
        ordered = df.select(F.col(c).cast("string").alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
        ordered.write.text(f"{directory}/{name}")
        return _numbered(df.sparkSession, f"{directory}/{name}", c).withColumnRenamed("ix", ix)

    genes, cells = indexed(var, "gene_id", "gene_ix", "genes.txt"), indexed(obs, "cell_id", "cell_ix", "barcodes.txt")
    text = counts.withColumn("cell_id", F.col("cell_id").cast("string")).withColumn("gene_id", F.col("gene_id").cast("string"))
    body = text.join(genes, "gene_id").join(cells, "cell_id").select(F.concat_ws(" ", "gene_ix", "cell_ix", F.col("count").cast("bigint")).alias("value"))
    # The size line goes to a part of its own that sorts before the parts of the entries.
    header = [("%%MatrixMarket matrix coordinate integer general",), (f"{genes.count()} {cells.count()} {body.count()}",)]
    head = counts.sparkSession.createDataFrame(header, "value string").coalesce(1)
    head.write.text(f"{directory}/matrix.mtx/part=0")
    body.write.text(f"{directory}/matrix.mtx/part=1")
    obs.write.option("header", True).csv(f"{directory}/metadata.csv")


def handle(parent: str | None, op: str, params: Mapping[str, object], version: str = "1") -> str:
    """Deterministic dataset handle from its parent, operation, parameters and the operation's version."""
    text = json.dumps({"parent": parent, "op": op, "params": dict(params), "version": version}, sort_keys=True, default=str)
    return "ds_" + hashlib.sha1(text.encode()).hexdigest()[:8]


_CATALOGUE = "dataset_id string, parent_id string, op string, params_json string, place string, created_at timestamp"


def _registered(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue; empty before the first bundle."""
    path = f"{root}/catalogue"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(_CATALOGUE).parquet(path) if exists else spark.createDataFrame([], _CATALOGUE)


def export_table(spark: SparkSession, root: str, dataset_id: str, table: str, path: str) -> None:
    """Copy a table of a handle to a path outside the store."""
    load_bundle(spark, root, dataset_id, table).write.parquet(path)


def save_bundle(tables: Mapping[str, DataFrame], root: str, parent: str | None, op: str, params: Mapping[str, object]) -> str:
    """Write a dataset's tables under its handle, then register it; the catalogue row comes last.

    Tables go to a folder of this attempt that the catalogue row names, so a reader never sees half a bundle and a
    failed attempt leaves nothing that is read.  A handle that is registered already is left as it is.
    """
    ds = handle(parent, op, params)
    spark = next(iter(tables.values())).sparkSession
    if _registered(spark, root).where(F.col("dataset_id") == ds).limit(1).count():
        return ds
    place = f"{ds}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{place}/{name}")
    row = spark.createDataFrame([(ds, parent, op, json.dumps(dict(params), sort_keys=True, default=str), place)],
                                "dataset_id string, parent_id string, op string, params_json string, place string")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/catalogue")
    return ds


def load_bundle(spark: SparkSession, root: str, dataset_id: str, table: str) -> DataFrame:
    found = _registered(spark, root).where(F.col("dataset_id") == dataset_id).orderBy("created_at").first()
    if found is None:
        raise ValueError(f"{dataset_id} is not registered")
    return spark.read.parquet(f"{root}/{found['place']}/{table}")


def save_results(results: DataFrame, path: str, run_id: str, keys: tuple[str, ...] = ("label",)) -> None:
    """Append a result table under its run, partitioned for reads by run and key."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", *keys).parquet(path)

"""Ingest, assembly, metadata and doublet queries."""

from pyspark.sql import functions as F

from tallycell.operators import doublets, ingest, metadata
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql
from tallycell.sources import assemble

COLUMNS = ["sample", "condition", "label", "batch", "timepoint"]
_LONG = " UNION ALL ".join(f"SELECT sample AS s, '{c}' AS col, {c} AS level FROM obs" for c in COLUMNS)


@query("ingest_validation_report", sql(
    f"""SELECT 'duplicate_symbols' AS "check", 'warn' AS severity, (count(*) - count(DISTINCT symbol))::DOUBLE AS value,
      '' AS verdict FROM var
    UNION ALL SELECT 'organism_by_casing', 'info', {r("avg((upper(symbol) = symbol)::INT::DOUBLE)")}, 'mouse' FROM var
    UNION ALL SELECT 'non_gene_features', 'warn', count(*)::DOUBLE, '' FROM var
    UNION ALL SELECT 'matrix_state', 'info', max(n)::DOUBLE, 'counts' FROM counts
    UNION ALL SELECT 'zero_count_cells', CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END, count(*)::DOUBLE, ''
      FROM obs ANTI JOIN counts USING (cell_id)""", "counts", "obs", "var"))
def _(d):
    return six(ingest.validation_report(d.counts, d.obs, d.var))


@query("ingest_unique_names", sql(
    """SELECT gene_id, CASE WHEN k = 1 THEN symbol ELSE symbol || '-' || (k - 1) END AS unique_symbol FROM (
    SELECT gene_id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY gene_id) AS k FROM var)""", "var"))
def _(d):
    return ingest.unique_names(d.var).select("gene_id", "unique_symbol")


@query("ingest_describe_columns", sql(
    """SELECT col AS "column", count(DISTINCT level) AS n_levels, count(DISTINCT level) = 1 AS constant,
      CASE WHEN count(DISTINCT level) <= 30 THEN array_to_string(list_sort(list(DISTINCT level)), '|') END AS levels
    FROM long GROUP BY 1""", "obs", long=_LONG))
def _(d):
    return ingest.describe_columns(d.obs, COLUMNS)


_GROUPABLE = """SELECT col, k AS n_levels, h / ln(k) AS evenness,
      row_number() OVER (ORDER BY k, round(h / ln(k), 9) DESC, col) AS rank FROM (
    SELECT col, count(*) AS k, -sum(p * ln(p)) AS h FROM (SELECT col, level,
      count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY col) AS p FROM long GROUP BY 1, 2) GROUP BY 1)
    WHERE k BETWEEN 2 AND {}"""


@query("ingest_groupable_columns", sql(
    f"""SELECT col AS "column", n_levels, {r('evenness')} AS evenness, rank FROM g""", "obs",
    long=_LONG, g=_GROUPABLE.format(30)))
def _(d):
    return six(ingest.groupable_columns(d.obs, COLUMNS))


@query("ingest_sample_level_columns", sql(
    """SELECT col AS "column", count(DISTINCT level) AS n_levels FROM long WHERE col <> 'sample'
      AND col NOT IN (SELECT col FROM long GROUP BY col, s HAVING count(DISTINCT level) > 1)
    GROUP BY 1 HAVING count(DISTINCT level) <= 50""", "obs", long=_LONG))
def _(d):
    return ingest.sample_level_columns(d.obs, COLUMNS)


@query("ingest_confounding_candidates", sql(
    f"""SELECT col AS "column", n_levels, {r('evenness')} AS evenness, rank FROM g WHERE col <> 'batch'""", "obs",
    long=_LONG, g=_GROUPABLE.format(12)))
def _(d):
    return six(ingest.confounding_candidates(d.obs, COLUMNS, "batch"))


def _multisample(d):
    lines = d.table("lineitem").join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = {}
    for flag in "ANR":
        parts[flag] = (lines.where(F.col("l_returnflag") == flag)
                       .groupBy(F.col("o_custkey").alias("barcode"), F.col("l_partkey").alias("gene_id"))
                       .agg(F.sum("l_quantity").cast("bigint").alias("count")))
    table = d.spark.createDataFrame([("A", "burn", "D3"), ("N", "sham", "D3"), ("R", "burn", "D7")],
                                    "sample string, condition string, timepoint string")
    return assemble.build_multisample(parts, table)


_MULTI = """SELECT o_custkey || '_' || l_returnflag AS cell_id, l_returnflag AS sample, l_partkey AS gene_id,
    CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


@query("assemble_multisample_cells", sql(
    """SELECT cell_id, sample, CASE sample WHEN 'N' THEN 'sham' ELSE 'burn' END AS Type,
      CASE sample WHEN 'R' THEN 'D7' ELSE 'D3' END AS Timepoint, sum(n)::BIGINT AS total
    FROM multi GROUP BY 1, 2""", multi=_MULTI))
def _(d):
    m = _multisample(d)
    return m.obs.join(m.counts.groupBy("cell_id").agg(F.sum("count").alias("total")), "cell_id")


@query("assemble_multisample_genes", sql(
    "SELECT sample, count(DISTINCT gene_id) AS n_genes FROM multi GROUP BY 1", multi=_MULTI))
def _(d):
    return _multisample(d).gene_counts


def _graft(d):
    target = d.obs.select(F.concat(F.lit("s1_"), F.col("cell_id").cast("string"), F.lit("-1")).alias("cell_id"))
    source = d.counts.select(F.concat(F.lit("s1_"), F.col("cell_id").cast("string")).alias("cell_id"),
                             "gene_id", "count")
    return target, source


@query("assemble_barcode_strategies", sql(
    """SELECT strategy, count(*) AS n_matched FROM (
      SELECT 'no_suffix' AS strategy FROM tot UNION ALL SELECT 'neither' FROM tot) GROUP BY 1""", "tot"))
def _(d):
    t, s = _graft(d)
    return assemble.align_barcodes(t, s.select("cell_id").distinct()).strategies.select("strategy", "n_matched")


@query("assemble_attach_counts", sql(
    """SELECT 's1_' || cell_id || '-1' AS cell_id, count(*) AS n_genes, sum(n)::BIGINT AS total FROM counts GROUP BY 1""",
    "counts"))
def _(d):
    t, s = _graft(d)
    c = assemble.attach_counts(t, d.var, s).counts
    return c.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("count").alias("total"))


@query("assemble_attach_report", sql(
    """SELECT (SELECT count(*) FROM tot) AS n_matched, (SELECT count(*) FROM obs) AS n_cells,
      (SELECT count(*) FROM var SEMI JOIN counts USING (gene_id)) AS n_genes_matched,
      (SELECT count(*) FROM var) AS n_genes, 0.0::DOUBLE AS max_fraction""", "tot", "obs", "var"))
def _(d):
    t, s = _graft(d)
    return assemble.attach_counts(t, d.var, s).report


def _nation_table(d):
    n = d.table("nation")
    return n.where("n_nationkey <> 4").select(F.col("n_name").alias("sample"), F.col("n_regionkey").alias("condition"),
                                              F.col("n_nationkey").alias("replicate")).union(
        n.where("n_nationkey = 4").select(F.lit("NOWHERE"), F.lit(0), F.lit(0)))


@query("meta_annotate_samples", sql(
    """SELECT cell_id, sample, n_regionkey AS Type, n_nationkey AS Replicate FROM obs
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 4) ON n_name = sample""", "obs"))
def _(d):
    return metadata.annotate_samples(d.obs.select("cell_id", "sample"), _nation_table(d)).obs


@query("meta_uncovered_samples", "SELECT n_name AS sample FROM nation WHERE n_nationkey = 4")
def _(d):
    return metadata.annotate_samples(d.obs, _nation_table(d)).uncovered


@query("meta_extra_samples", "SELECT 'NOWHERE' AS sample FROM nation WHERE n_nationkey = 4")
def _(d):
    return metadata.annotate_samples(d.obs, _nation_table(d)).extra


@query("meta_parse_names", """SELECT p_name, true AS matched, split_part(p_name, ' ', 1) AS colour,
    split_part(p_name, ' ', 2) AS kind FROM (SELECT DISTINCT p_name FROM part)""")
def _(d):
    return metadata.parse_names(d.table("part").select("p_name").distinct(), r"^(?P<colour>\w+) (?P<kind>\w+)$", "p_name")


@query("meta_levels_by_number", """SELECT level, row_number() OVER (ORDER BY
    regexp_extract(level, '\\d+\\.?\\d*')::DOUBLE, level) AS ord FROM (SELECT DISTINCT p_brand AS level FROM part)""")
def _(d):
    return metadata.levels_by_number(d.table("part"), "p_brand")


@query("meta_explicit_order", """SELECT o_orderpriority AS level, CASE left(o_orderpriority, 1) WHEN '1' THEN 1
    WHEN '2' THEN 2 WHEN '5' THEN 3 END AS ord FROM orders GROUP BY 1, 2""")
def _(d):
    return metadata.explicit_order(d.table("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("meta_natural_order", """SELECT level, row_number() OVER (ORDER BY regexp_extract(level, '\\d+')::INT) AS ord
    FROM (SELECT DISTINCT n_name AS level FROM nation)""")
def _(d):
    return metadata.natural_order(d.table("nation"), "n_name")


@query("meta_composite_levels", sql(
    """SELECT level, row_number() OVER (ORDER BY num, condition) AS ord FROM (SELECT DISTINCT timepoint || '_' || condition
      AS level, substr(timepoint, 2)::INT AS num, condition FROM obs)""", "obs"))
def _(d):
    return metadata.composite_column(d.obs, ["timepoint", "condition"], "group").levels


@query("meta_composite_cells", sql(
    "SELECT timepoint || '_' || condition AS \"group\", count(*) AS n FROM obs GROUP BY 1", "obs"))
def _(d):
    return (metadata.composite_column(d.obs, ["timepoint", "condition"], "group").obs
            .groupBy("group").agg(F.count(F.lit(1)).alias("n")))


@query("meta_modal_values", sql(
    """SELECT sample, (SELECT label FROM (SELECT label, count(*) c FROM obs o WHERE o.sample = s.sample GROUP BY 1)
        ORDER BY c DESC, label LIMIT 1) AS label,
      (SELECT batch FROM (SELECT batch, count(*) c FROM obs o WHERE o.sample = s.sample GROUP BY 1)
        ORDER BY c DESC, batch LIMIT 1) AS batch FROM (SELECT DISTINCT sample FROM obs) s""", "obs"))
def _(d):
    return metadata.modal_values(d.obs, ["label", "batch"])


_ENR = """SELECT *, exp(0) AS one FROM (SELECT sample, count(*) AS n_cells, sum((score > 8000)::INT) AS k
    FROM obs GROUP BY 1), (SELECT avg((score > 8000)::INT) AS p0 FROM obs)"""
_ENRP = """SELECT sample, n_cells, k, p0, k / n_cells AS rate, CASE WHEN k = 0 THEN 1.0 ELSE least(1.0,
    (SELECT sum(exp(lgamma(n_cells + 1) - lgamma(i + 1) - lgamma(n_cells - i + 1) + i * ln(p0) + (n_cells - i) * ln(1 - p0)))
     FROM range(0, 100000) t(i) WHERE i >= k AND i <= n_cells)) END AS p FROM e"""


def enrichment_sql():
    return sql(f"""SELECT sample, n_cells, CAST(k AS BIGINT) AS n_doublets, {r('rate')} AS rate, {r('p0')} AS base_rate,
        {r('p')} AS pval, {r('rate / p0')} AS enrichment, {r('fdr')} AS fdr, (fdr < 0.05 AND rate / p0 > 1.2) AS flagged
      FROM (SELECT *, least(1.0, min(p * m / rk) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS fdr
      FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM ep))""",
               "obs", e=_ENR, ep=_ENRP)


@query("doublet_cluster_enrichment", enrichment_sql())
def _(d):
    obs = d.obs.withColumn("predicted_doublet", F.col("score") > 8000)
    return six(doublets.cluster_enrichment(obs, "sample", min_ratio=1.2))


@query("doublet_calls_from_score", sql(
    """SELECT label, count(*) AS n, CAST(sum((score > (SELECT quantile_cont(score, 0.9) FROM obs))::INT) AS BIGINT) AS called
    FROM obs GROUP BY 1""", "obs"))
def _(d):
    return doublets.call_from_score(d.obs, "score").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("predicted_doublet").alias("called"))


@query("doublet_drop", sql("SELECT cell_id, sample FROM obs WHERE NOT score > 8000", "obs"))
def _(d):
    return doublets.drop_doublets(d.obs.withColumn("predicted_doublet", F.col("score") > 8000)).select("cell_id", "sample")

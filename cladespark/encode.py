"""Evolutionary data out of the relational tables, over all of their rows.

Taxa are nations and sites are parts. The state of a site is inherited from the part, changed in a region where the region's
quantity says so, and changed again in a nation likewise, so the true tree is root - regions - nations. A nation that never
bought a part has no row there: missing data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.sides import tasks_for

SALES_ROWS = 1 << 16  #: rows of sales in a task: folds over trees make tens of rows of each, in one task
JOIN_ROWS = 1 << 18  #: rows of the larger side in a task of a join, and most rows of a side that is broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: tuple[int, int]) -> DataFrame:
    """An inner join of narrow tables of so many rows: by a broadcast of a small right side, else by tasks of a bounded number of rows at any size of the tables,
    also where files are so small for their rows that Spark would broadcast a side."""
    on = F.col(left_key) == F.col(right_key)
    if rows[1] <= JOIN_ROWS:
        return left.join(F.broadcast(right), on)
    tasks = tasks_for(left.sparkSession, max(rows), JOIN_ROWS)
    return left.repartition(tasks, left_key).join(right.repartition(tasks, right_key).hint("merge"), on)


def bought(spark: SparkSession, sf_dir: str, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """``orders`` with their ``customer``: columns of all rows of the two tables."""
    sizes = table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "customer").count()
    return dealt_join(orders, customer, "o_custkey", "c_custkey", sizes)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taxon, region, site, q, rq``: quantity of each part by nation, and by its region."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    who = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    who = who.select("c_custkey", F.col("n_nationkey").alias("taxon"), F.col("n_regionkey").alias("region"))
    size = line.count()
    joined = dealt_join(line, bought(spark, sf_dir, order, who), "l_orderkey", "o_orderkey", (size, order.count()))
    # Lines go to their site at once, as few of a task's lines share nation and site; what follows, site by site, needs no other shuffle.
    by_site = joined.withColumnRenamed("l_partkey", "site").repartition(tasks_for(spark, size, SALES_ROWS), "site")
    q = by_site.groupBy("taxon", "region", "site").agg(F.sum("l_quantity").cast("long").alias("q"))
    return q.withColumn("rq", F.sum("q").over(Window.partitionBy("site", "region")))


def _states(frame: DataFrame, n: int) -> DataFrame:
    changed = lambda c, every: F.when(F.col(c) % every == 0, 1 + F.floor(F.col(c) / every) % (n - 1)).otherwise(0)
    return frame.select("taxon", "region", "site", ((F.col("site") + changed("rq", 4) + changed("q", 6)) % n).cast("int").alias("state"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleotides: ``taxon, region, site, state`` with A, C, G, T as 0 to 3."""
    return _states(sales(spark, sf_dir), 4)


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amino acids: ``taxon, region, site, state`` with 20 states."""
    return _states(sales(spark, sf_dir), 20)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, parent, ord, bl, level``: the root -1, regions 100 + key, nations as leaves."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    bl = lambda c: 0.05 + 0.01 * (F.col(c) % 7)
    leaves = nation.select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") + 100).alias("parent"), F.col("n_nationkey").alias("ord"), bl("n_nationkey").alias("bl"), F.lit(2).alias("level"))
    inner = region.select((F.col("r_regionkey") + 100).alias("node"), F.lit(-1).alias("parent"), F.col("r_regionkey").alias("ord"), bl("r_regionkey").alias("bl"), F.lit(1).alias("level"))
    root = spark.range(1).select(F.lit(-1).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("ord"), F.lit(0.0).alias("bl"), F.lit(0).alias("level"))
    return leaves.unionByName(inner).unionByName(root)


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene frequencies ``pop, locus, allele, f``: shares of customers' segments and of orders' priorities by nation."""
    customer = table(spark, sf_dir, "customer")
    segment = customer.select(F.col("c_nationkey").alias("pop"), F.lit("segment").alias("locus"), F.col("c_mktsegment").alias("allele"))
    orders = bought(spark, sf_dir, table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), customer.select("c_custkey", "c_nationkey"))
    priority = orders.select(F.col("c_nationkey").alias("pop"), F.lit("priority").alias("locus"), F.col("o_orderpriority").alias("allele"))
    counts = segment.unionByName(priority).groupBy("pop", "locus", "allele").agg(F.count("*").alias("n"))
    return counts.select("pop", "locus", "allele", (F.col("n") / F.sum("n").over(Window.partitionBy("pop", "locus"))).alias("f"))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary characters ``taxon, char, state``: a nation bought more of a brand than nations on average."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    q = sales(spark, sf_dir).join(part, F.col("site") == F.col("p_partkey")).groupBy("taxon", F.col("p_brand").alias("char")).agg(F.sum("q").alias("q"))
    return q.select("taxon", "char", (F.col("q") > F.avg("q").over(Window.partitionBy("char"))).cast("int").alias("state"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous characters ``taxon, char, value``: means of the embeddings' dimensions by label."""
    found = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("char", "x"))
    return found.groupBy(F.col("label").alias("taxon"), "char").agg(F.avg(F.col("x").cast("double")).alias("value"))


def label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of the embeddings' n labels, numbered as a heap: the parent of node k is k / 2, the labels in order are the nodes n to 2 n - 1.
    ``node, parent, ord, bl, level``; ``label``: of leaves."""
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    listed = labels.agg(F.array_sort(F.collect_list("label")).alias("l"))  # tens of labels
    n = F.size("l")
    nodes = listed.select("l", n.alias("n"), F.explode(F.sequence(F.lit(1), 2 * n - 1)).alias("node"))
    label = F.when(F.col("node") >= F.col("n"), F.try_element_at("l", F.greatest(F.col("node") - F.col("n") + 1, F.lit(1))))
    parent = F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("int"))
    bl = F.when(F.col("node") > 1, 0.1 + 0.05 * (F.col("node") % 5)).otherwise(0.0)
    return nodes.select("node", parent.alias("parent"), (F.col("node") % 2).alias("ord"), bl.alias("bl"), F.floor(F.log2("node") + 1e-9).cast("int").alias("level"), label.alias("label"))


LABEL_TREE_SQL = """labels AS (SELECT label, row_number() OVER (ORDER BY label) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
label_tree AS (SELECT x.node::INTEGER AS node, (CASE WHEN x.node > 1 THEN x.node // 2 END)::INTEGER AS parent, (x.node % 2)::INTEGER AS ord, CASE WHEN x.node > 1 THEN 0.1e0 + 0.05e0 * (x.node % 5) ELSE 0e0 END AS bl, floor(log2(x.node) + 1e-9)::INTEGER AS level, label
  FROM (SELECT unnest(generate_series(1, 2 * max(n) - 1)) AS node FROM labels) x LEFT JOIN labels ON x.node = n + k - 1)"""


#: The same views for DuckDB.
SALES_SQL = """sales AS (SELECT *, sum(q) OVER (PARTITION BY region, site)::BIGINT AS rq FROM (SELECT n_nationkey AS taxon, n_regionkey AS region, l_partkey AS site, sum(l_quantity)::BIGINT AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL))"""


def states_sql(n: int, name: str) -> str:
    return f"{name} AS (SELECT taxon, region, site, ((site + CASE WHEN rq % 4 = 0 THEN 1 + (rq // 4) % {n - 1} ELSE 0 END + CASE WHEN q % 6 = 0 THEN 1 + (q // 6) % {n - 1} ELSE 0 END) % {n})::INTEGER AS state FROM sales)"


SITES_SQL = f"{SALES_SQL},\n{states_sql(4, 'sites')}"
RESIDUES_SQL = f"{SALES_SQL},\n{states_sql(20, 'residues')}"
TREE_SQL = """tree AS (SELECT n_nationkey::INTEGER AS node, (n_regionkey + 100)::INTEGER AS parent, n_nationkey::INTEGER AS ord, 0.05e0 + 0.01e0 * (n_nationkey % 7) AS bl, 2 AS level FROM nation
  UNION ALL SELECT r_regionkey + 100, -1, r_regionkey, 0.05e0 + 0.01e0 * (r_regionkey % 7), 1 FROM region UNION ALL SELECT -1, NULL, 0, 0e0, 0)"""
FREQUENCIES_SQL = """freqs AS (SELECT pop, locus, allele, n / sum(n) OVER (PARTITION BY pop, locus)::DOUBLE AS f FROM (
  SELECT c_nationkey AS pop, 'segment' AS locus, c_mktsegment AS allele, count(*)::DOUBLE AS n FROM customer GROUP BY ALL
  UNION ALL SELECT c_nationkey, 'priority', o_orderpriority, count(*)::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""
CHARACTERS_SQL = f"""{SALES_SQL},
chars AS (SELECT taxon, char, (q > avg(q) OVER (PARTITION BY char))::INTEGER AS state FROM (SELECT taxon, p_brand AS char, sum(q)::DOUBLE AS q FROM sales JOIN part ON site = p_partkey
      GROUP BY ALL))"""
TRAITS_SQL = """traits AS (SELECT label AS taxon, i - 1 AS char, avg(embedding[i]::DOUBLE) AS value FROM embeddings, (SELECT unnest(generate_series(1, 64))::INTEGER AS i) GROUP BY ALL)"""


def clades(spark: SparkSession, sf_dir: str, by: str = "concat_ws(':', o_orderpriority, o_orderstatus)") -> DataFrame:
    """Trees, one per group of orders: nations in order of their orders' value are the tips of a balanced binary tree.
    ``tree, node, bit, bl``: a row for each tip under each inner node."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.expr(by).alias("tree"))
    value = bought(spark, sf_dir, orders, customer).groupBy("tree", F.col("c_nationkey").alias("taxon")).agg(F.sum("o_totalprice").alias("v"))
    slot = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("v"), "taxon")) - 1
    sized = value.select("tree", "taxon", slot.alias("slot")).withColumn("size", F.explode(F.array(*map(F.lit, (2, 4, 8, 16)))))
    node = F.concat_ws(":", F.col("size").cast("string"), F.floor(F.col("slot") / F.col("size")).cast("string"))
    return sized.select("tree", node.alias("node"), F.pow(F.lit(2.0), F.col("taxon")).cast("long").alias("bit"), (0.01 * F.col("size")).alias("bl"))


def splits_sql(name: str, by: str = "o_orderpriority || ':' || o_orderstatus", n_taxa: int = 25) -> str:
    full = (1 << n_taxa) - 1
    return f"""{name} AS (SELECT tree, split, sum(bl) AS bl FROM (SELECT tree, CASE WHEN mask & 1 = 1 THEN {full} - mask ELSE mask END AS split, bl FROM (
    SELECT tree, size, slot // size AS node, bit_or(1::BIGINT << taxon)::BIGINT AS mask, 0.01e0 * size AS bl
      FROM (SELECT tree, taxon, row_number() OVER (PARTITION BY tree ORDER BY v DESC, taxon) - 1 AS slot
      FROM (SELECT {by} AS tree, c_nationkey::BIGINT AS taxon, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey
      GROUP BY ALL)), (SELECT unnest([2, 4, 8, 16]) AS size) GROUP BY ALL))
  WHERE bit_count(split) > 1 AND bit_count(split) < {n_taxa - 1} GROUP BY ALL)"""


def ranked(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """``tree, taxon, slot, n``: for each group of orders the nations in order of their orders' value, and how many there are."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.expr(by).alias("tree"))
    joined = bought(spark, sf_dir, orders, customer)
    value = joined.groupBy("tree", F.col("c_nationkey").alias("taxon")).agg(F.sum("o_totalprice").alias("v"))
    slot = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("v"), "taxon")) - 1
    return value.select("tree", "taxon", slot.alias("slot"), F.count("*").over(Window.partitionBy("tree")).alias("n"))


def forest(spark: SparkSession, sf_dir: str, by: str = "concat_ws(':', o_orderpriority, o_orderstatus)") -> DataFrame:
    """The trees of :func:`clades` as ``tree, node, parent, ord, bl``: nations are the tips, and the node of height k over the slots from i 2^k has
    the number k 2^32 + i."""
    tips = ranked(spark, sf_dir, by)
    node = lambda k, at: (k.cast("long") * (1 << 32) + at).cast("long")
    up = F.floor(F.col("slot") / 2)
    leaf = tips.select("tree", F.col("taxon").cast("long").alias("node"), node(F.lit(1), up).alias("parent"), (F.col("slot") % 2).cast("int").alias("ord"), F.lit(0.01).alias("bl"))
    top = F.ceil(F.log2("n") - 1e-9).cast("int")
    sized = tips.select("tree", "slot", top.alias("top"), F.explode(F.sequence(F.lit(1), top)).alias("k"))
    inner = sized.select("tree", "top", "k", F.floor(F.col("slot") / F.pow(F.lit(2), F.col("k"))).alias("i")).distinct()
    above = F.when(F.col("k") < F.col("top"), node(F.col("k") + 1, F.floor(F.col("i") / 2)))
    length = F.when(F.col("k") < F.col("top"), 0.01 * F.pow(F.lit(2), F.col("k"))).otherwise(0.0)
    return leaf.unionByName(inner.select("tree", node(F.col("k"), F.col("i")).alias("node"), above.alias("parent"), (F.col("i") % 2).cast("int").alias("ord"), length.alias("bl")))


SLOTS_SQL = """slots AS (SELECT tree, taxon, row_number() OVER (PARTITION BY tree ORDER BY v DESC, taxon) - 1 AS slot FROM (
  SELECT o_orderpriority || ':' || o_orderstatus AS tree, c_nationkey AS taxon, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""

"""Results as text and JSON, built by DataFrame expressions, so any number of alignments is written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.newick import explode_trees


def _lines(rows: DataFrame, keys: list[str], order: str, line) -> DataFrame:
    """One text for each group: its lines in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def distance_text(distances: DataFrame, group: str = "aln_id") -> DataFrame:
    """``group, text``: a square matrix with names of ten characters, as ``formats.distance_matrix`` reads it. ``distances``: ``group, i, j, d``, each pair once."""
    d = distances.select(group, F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.col("d").cast("double").alias("d"))
    names = d.select(group, F.explode(F.array("i", "j")).alias("i")).distinct()
    every = d.unionByName(d.select(group, F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(names.select(group, "i", F.col("i").alias("j"), F.lit(0.0).alias("d")))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: F.format_string("%10.6f", x["d"]))
    rows = every.groupBy(group, "i").agg(F.concat(F.rpad(F.substring("i", 1, 10), 10, " "), F.array_join(cells, "")).alias("line"), F.count("*").alias("n"))
    found = _lines(rows, [group, "n"], "i", F.col("line"))
    return found.select(group, F.concat(F.format_string("%5d", F.col("n")), F.lit("\n"), F.col("text")).alias("text"))


def tree_text(trees: DataFrame, group: str = "aln_id", value: str | None = None) -> DataFrame:
    """``group, text``: the tree, its value (such as ``lnl`` or ``steps``) and a table of its branches. ``trees``: ``group, newick``; unreadable trees have no branches."""
    nodes = explode_trees(trees, group)
    name = F.coalesce("name", F.concat(F.lit("node "), F.col("id").cast("string")))
    branch = F.concat(F.rpad(F.concat(F.lit("node "), F.col("parent").cast("string")), 12, " "), F.rpad(name, 24, " "), F.coalesce(F.format_string("%12.6f", "bl"), F.lpad(F.lit("-"), 12, " ")))
    table = _lines(nodes.where("parent is not null"), [group], "id", branch).withColumnRenamed("text", "branches")
    head = F.concat(F.lit("tree: "), F.col("newick"))
    if value:
        head = F.concat(head, F.lit(f"\n{value}: "), F.col(value).cast("string"))
    return trees.join(table, group, "left").select(group, F.concat_ws("\n", head, "branches").alias("text"))


def clades(trees: DataFrame, group: str = "aln_id") -> DataFrame:
    """``group, clade, length``: the taxa below each inner branch, in order."""
    nodes = explode_trees(trees, group)
    current = nodes.where("name is not null").select(group, "id", F.col("name").alias("tip"))
    edges = nodes.select(group, "id", "parent")
    height = nodes.agg(F.max("level")).first()[0] or 0
    found = None
    for _ in range(height):
        current = current.join(edges, [group, "id"]).where("parent is not null").select(group, F.col("parent").alias("id"), "tip")
        found = current if found is None else found.unionByName(current)
    if found is None:
        return nodes.limit(0).select(group, F.lit("").alias("clade"), F.col("bl").alias("length"))
    inner = nodes.where("parent is not null").select(group, "id", F.col("bl").alias("length"))
    return found.groupBy(group, "id").agg(F.array_join(F.array_sort(F.collect_set("tip")), ",").alias("clade")).join(inner, [group, "id"]).select(group, "clade", "length")


def site_summary(lnl: DataFrame, group: str = "tree") -> DataFrame:
    """``group, sites, total, least, mean, greatest`` of site likelihoods."""
    return lnl.groupBy(group).agg(F.count("*").alias("sites"), *(F.round(f("lnl"), 6).alias(n) for f, n in ((F.sum, "total"), (F.min, "least"), (F.avg, "mean"), (F.max, "greatest"))))


def as_json(results: DataFrame) -> DataFrame:
    """``value``: each row as a JSON object, for ``write.text`` or a service."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def save_text(texts: DataFrame, path: str) -> None:
    """The texts of ``distance_text`` or ``tree_text``, a file for each partition."""
    texts.select("text").write.text(path)

"""Node tables as Newick text: a fold of strings from the tips up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import height_of, keys, with_levels


def length_text(bl: Column) -> Column:
    """``:`` and a length with at most ten decimals; nothing for null."""
    decimals = F.format_string("%.10f", bl.cast("double"))
    return F.when(bl.isNotNull(), F.concat(F.lit(":"), F.rtrim(F.rtrim(decimals, F.lit("0")), F.lit(".")))).otherwise("")


def newick_texts(nodes: DataFrame) -> DataFrame:
    """``[tree,] newick`` of trees ``[tree,] node, parent, ord, name, bl`` (and ``level``, else it is found first).

    Children come in the order of ``ord``, then of ``node``; blanks in names become underscores; null names and lengths are left out. A level is one aggregation; no
    task sees more of a tree than a node's children.
    """
    key = keys(nodes)
    nodes = nodes if "level" in nodes.columns else with_levels(nodes)
    own = F.concat(F.coalesce(F.replace("name", F.lit(" "), F.lit("_")), F.lit("")), length_text(F.col("bl")))
    named = nodes.select(*key, "node", "parent", "ord", "level", own.alias("own"))
    below = None
    for level in range(height_of(nodes), -1, -1):
        here = named.where(F.col("level") == level)
        if below is not None:
            listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node", "text"))), lambda x: x["text"]), ",")
            inside = below.groupBy(*key, F.col("parent").alias("node")).agg(F.concat(F.lit("("), listed, F.lit(")")).alias("inside"))
            here = here.join(inside, [*key, "node"], "left").withColumn("own", F.concat(F.coalesce("inside", F.lit("")), "own"))
        below = here.select(*key, "node", "parent", "ord", F.col("own").alias("text"))
    return below.select(*key, F.concat("text", F.lit(";")).alias("newick"))

"""Queries on cognates of languages, and on trees as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import encode as E
from ..functions.newick import lateral_trees
from ..operators import cognates as C
from ..operators import folds as T
from ..operators import splits as P
from ..operators.newick_text import newick_texts
from .book import add
from .trees import EXTENDED_SQL, TAXA, _extended, _forest


def _classes(s, d):
    return C.cognate_classes(C.basic_words(E.table(s, d, "documents").select("doc_id", "lang", "text")))


PLAIN = f"translate(lower(text), '{C.MARKED}', '{C.UNMARKED}')"
WORDS_SQL = f"""total AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang),
words AS (SELECT lang, word FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all({PLAIN}, '[a-z]+'))) AS word FROM documents WHERE lang IS NOT NULL)
  WHERE length(word) >= 3 GROUP BY ALL) JOIN total USING (lang) WHERE n >= 0.05e0 * docs),
every AS (SELECT DISTINCT word FROM words),
near AS (SELECT x.word AS a, y.word AS b FROM every x JOIN every y ON x.word < y.word AND abs(length(x.word) - length(y.word)) <= greatest(length(x.word), length(y.word)) // {C.PER}
  WHERE levenshtein(x.word, y.word) <= greatest(length(x.word), length(y.word)) // {C.PER}),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (SELECT word AS node, word AS root FROM every UNION SELECT b, root FROM reached JOIN both_ways ON node = a),
class AS (SELECT node AS word, min(root) AS class FROM reached GROUP BY node)"""
add("cognate_classes", _classes, f"WITH RECURSIVE {WORDS_SQL} SELECT lang, word, class FROM words JOIN class USING (word)")
MATRIX_SQL = f"""{WORDS_SQL}, has AS (SELECT DISTINCT lang, class FROM words JOIN class USING (word)),
matrix AS (SELECT l.lang AS taxon, c.class AS char, (h.lang IS NOT NULL)::INTEGER AS state
  FROM (SELECT DISTINCT lang FROM has) l CROSS JOIN (SELECT DISTINCT class FROM has) c LEFT JOIN has h ON h.lang = l.lang AND h.class = c.class)"""
add("cognate_matrix", lambda s, d: C.cognate_matrix(_classes(s, d)), f"WITH RECURSIVE {MATRIX_SQL} SELECT * FROM matrix")

#: The three trees of four languages.
FAMILIES = {"en+de": ("en", "de", "fr", "es"), "en+fr": ("en", "fr", "de", "es"), "en+es": ("en", "es", "de", "fr")}


def cognate_parsimony(s, d):
    """Steps of all classes on each of the three trees of the languages: ``tree, steps, sites``."""
    rows = []
    for name, (a, b, c, e) in FAMILIES.items():
        rows += [(name, "root", None, 0), (name, "left", "root", 0), (name, "right", "root", 1), (name, a, "left", 0), (name, b, "left", 1), (name, c, "right", 0), (name, e, "right", 1)]
    forest = T.with_levels(s.createDataFrame(rows, "tree string, node string, parent string, ord int").withColumn("bl", F.lit(0.1)))
    matrix = C.cognate_matrix(_classes(s, d))
    numbered = matrix.select("char").distinct().withColumn("site", F.xxhash64("char"))  # any distinct numbers will do
    leaves = matrix.join(numbered, "char").select(F.col("taxon").alias("node"), "site", (F.col("state") + 1).alias("mask"))
    return T.fitch_scores(forest, leaves)


def _families_sql() -> str:
    wide = ", ".join(f"max(state) FILTER (taxon = '{x}') AS {x}" for x in ("en", "de", "fr", "es"))
    each = " UNION ALL ".join(
        f"SELECT '{n}' AS tree, sum(CASE {a} + {b} + {c} + {e} WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 2 THEN CASE WHEN {a} = {b} THEN 1 ELSE 2 END ELSE 1 END)::BIGINT AS steps, count(*) AS sites FROM wide"
        for n, (a, b, c, e) in FAMILIES.items()
    )
    return f"WITH RECURSIVE {MATRIX_SQL}, wide AS (SELECT char, {wide} FROM matrix GROUP BY char) {each}"


add("cognate_parsimony", cognate_parsimony, _families_sql())


def consensus_newick(s, d):
    """The extended consensus of the trees of orders as text: nations' names at the tips, support at inner nodes."""
    made = P.consensus_tree(_extended(s, d), TAXA)
    names = E.table(s, d, "nation").select(F.expr("shiftleft(1L, cast(n_nationkey AS int))").alias("node"), F.col("n_name").alias("name"))
    label = F.coalesce("name", F.when(F.col("support").isNotNull(), F.format_string("%.2f", "support")))
    return newick_texts(made.join(F.broadcast(names), "node", "left").select("node", "parent", F.col("node").alias("ord"), label.alias("name"), "bl"))


LENGTH_SQL = "coalesce(':' || rtrim(rtrim(printf('%.10f', bl), '0'), '.'), '')"


def _consensus_newick_sql() -> str:
    full = (1 << TAXA) - 1
    out = [
        f"""WITH RECURSIVE {EXTENDED_SQL}, nodes AS (SELECT (1::BIGINT << n_nationkey::INTEGER) AS node, replace(n_name, ' ', '_') AS label, NULL::DOUBLE AS bl FROM nation
        UNION ALL SELECT split, printf('%.2f', support), bl FROM accepted), above AS (SELECT split AS a FROM accepted UNION ALL SELECT {full}),
        up AS (SELECT node, arg_min(a, bit_count(a) * {1 << (TAXA + 1)} + a) AS parent, any_value(label) || any_value({LENGTH_SQL}) AS own
          FROM nodes JOIN above ON a <> node AND a & node = node GROUP BY node
          UNION ALL SELECT {full}, NULL, ''),
        depth AS (SELECT node, parent, own, 0 AS level FROM up WHERE parent IS NULL UNION ALL SELECT up.node, up.parent, up.own, level + 1 FROM up JOIN depth ON up.parent = depth.node),
        t{TAXA} AS (SELECT NULL::BIGINT AS node, NULL::BIGINT AS parent, NULL::VARCHAR AS txt WHERE false)"""
    ]
    for k in range(TAXA - 1, -1, -1):
        inside = f"SELECT parent AS up, '(' || string_agg(txt, ',' ORDER BY node) || ')' AS inside FROM t{k + 1} GROUP BY parent"
        out.append(f"t{k} AS (SELECT node, parent, coalesce(inside, '') || own AS txt FROM depth LEFT JOIN ({inside}) ON up = node WHERE level = {k})")
    return ",\n".join(out) + "\nSELECT txt || ';' AS newick FROM t0"


add("consensus_newick", consensus_newick, _consensus_newick_sql())


def newick_tips(s, d):
    """The trees of orders written as text and read again by the table function: ``tree, name, level, ord, bl`` of their tips."""
    names = E.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    texts = newick_texts(_forest(s, d).join(F.broadcast(names), "node", "left"))
    return lateral_trees(texts).where("name is not null").select("tree", "name", "level", "ord", "bl")


add(
    "newick_tips",
    newick_tips,
    f"""WITH {E.SLOTS_SQL}, n AS (SELECT tree, ceil(log2(count(*)) - 1e-9)::INTEGER AS level FROM slots GROUP BY tree)
    SELECT tree, replace(n_name, '_', ' ') AS name, level, CASE WHEN slot % 2 = 1 THEN 1 ELSE 0 END::INTEGER AS ord, 0.01e0 AS bl FROM slots JOIN n USING (tree) JOIN nation ON n_nationkey = taxon""",
)

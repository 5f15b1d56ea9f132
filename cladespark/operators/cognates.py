"""Words that may have one origin: a similarity join by edit distance, its classes, and the matrix of languages by classes.

Two words are alike if their edit distance is at most a share of the longer one's length. A word that is cut into one piece more than the edits
allowed keeps one piece whole in every word that is alike, near the same place. So candidates share a piece, which an equi-join finds, and only they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PER = 6  #: letters of the longer word for each edit allowed


def edits(length: Column, per: int = PER) -> Column:
    return F.floor(length / per).cast("int")


def _piece(k: Column, length: Column, most: Column) -> tuple[Column, Column]:
    """Begin (from 0) and length of piece ``k`` of ``most + 1`` even ones, the longer ones last."""
    base, more = F.floor(length / (most + 1)).cast("int"), (length % (most + 1)).cast("int")
    short = most + 1 - more
    return k * base + F.greatest(F.lit(0), k - short), base + F.when(k >= short, 1).otherwise(0)


def alike(words: DataFrame, per: int = PER) -> DataFrame:
    """``a < b, d`` of all pairs of distinct words ``word`` whose edit distance ``d`` is at most ``edits`` of the longer one's length.

    Words that are null or shorter than ``per`` are alike to none but themselves. A piece that very many words share is left to adaptive skew splitting.
    """
    sized = words.select("word").distinct().select("word", F.length("word").alias("own"))
    # as the shorter word of a pair, for each length that the longer one may have
    longer = F.explode(F.sequence(F.col("own"), F.col("own") + edits(F.col("own") * 2, per) + 1)).alias("longer")
    most = edits(F.col("longer"), per)
    asked = sized.select("word", "own", longer).where((F.col("longer") - F.col("own") <= most) & (most > 0))
    asked = asked.select("word", "own", "longer", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    start, size = _piece(F.col("k"), F.col("own"), most)
    pieces = asked.select(F.col("word").alias("x"), "longer", "own", "k", F.substring("word", start + 1, size).alias("piece"))
    # as the longer one, for each length that the shorter one may have, at each place that the edits may have moved a piece to
    found = sized.select("word", F.col("own").alias("longer")).where(most > 0)
    found = found.select("word", "longer", F.explode(F.sequence(F.col("longer") - most, F.col("longer"))).alias("own"))
    found = found.select("word", "longer", "own", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    low, high = F.greatest(F.lit(0), start - most), F.least(F.col("longer") - size, start + most)
    places = found.where(low <= high).select("word", "longer", "own", "k", size.alias("size"), F.explode(F.sequence(low, high)).alias("at"))
    windows = places.select(F.col("word").alias("y"), "longer", "own", "k", F.substring("word", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    met = pieces.join(windows, ["longer", "own", "k", "piece"]).where("x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    within = edits(F.greatest(F.length("a"), F.length("b")), per)
    return pairs.withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= within)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, class`` (the least node reachable) of all ``nodes`` (``node``) over ``edges`` (``a, b``): each round a node takes the least class of its neighbours, and
    then the class of its class, so long chains shrink fast. Lineage is cut after each round."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    current = cut(nodes.select("node", F.col("node").alias("class")))
    while True:
        near = both.join(current, F.col("b") == F.col("node")).groupBy("a").agg(F.min("class").alias("low"))
        lower = current.join(near, F.col("node") == F.col("a"), "left").select("node", "class", F.least("class", F.coalesce("low", "class")).alias("to"))
        roots = lower.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        moved = cut(lower.join(roots, "to").select("node", F.col("class").alias("was"), F.least("to", "beyond").alias("class")))
        current = moved.select("node", "class")
        if moved.where("class <> was").isEmpty():
            return current


def basic_words(docs: DataFrame, share: float = 0.05, shortest: int = 3) -> DataFrame:
    """``lang, word``: words of at least ``shortest`` letters that at least a ``share`` of a language's documents have: what is common enough to be compared.

    Letters are lower-cased and lose their marks. ``docs``: ``doc_id, lang, text``; null languages and texts have no words.
    """
    plain = F.translate(F.lower("text"), MARKED, UNMARKED)
    total = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("docs"))
    words = docs.where("lang is not null").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    counts = words.where(F.length("word") >= shortest).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), "lang").where(F.col("n") >= share * F.col("docs")).select("lang", "word")  # a row for each language


MARKED, UNMARKED = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def cognate_classes(words: DataFrame, per: int = PER) -> DataFrame:
    """``lang, word, class``: the least word that a word's likes lead to, over all languages."""
    nodes = cut(words.select(F.col("word").alias("node")).distinct())
    found = components(nodes, alike(nodes.select(F.col("node").alias("word")), per))
    return words.join(found, F.col("word") == F.col("node")).select("lang", "word", "class")


def cognate_matrix(classes: DataFrame, most: int = 1000) -> DataFrame:
    """``taxon, char, state``: for every language and class 1 if the language has a word of it, else 0. There are at most ``most`` languages."""
    langs = sorted(r.lang for r in classes.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages")
    listed = classes.groupBy(F.col("class").alias("char")).agg(F.collect_set("lang").alias("has"))
    spread = listed.select("char", "has", F.explode(F.array(*map(F.lit, langs)).cast("array<string>")).alias("taxon"))
    return spread.select("taxon", "char", F.array_contains("has", F.col("taxon")).cast("int").alias("state"))

"""Aggregates over alignment columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distances import site_masks
from .sides import counted


def base_frequencies(sites: DataFrame) -> DataFrame:
    """``taxon`` and the shares of A, C, G, T among its known states."""
    share = lambda k: F.round(F.avg((F.col("state") == k).cast("double")), 6)
    return sites.groupBy("taxon").agg(*(share(k).alias(f"f{b}") for k, b in enumerate("acgt")))


def site_patterns(sites: DataFrame) -> DataFrame:
    """Distinct columns and how many sites have them; a site-additive score needs only these."""
    column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "state"))), lambda x: F.concat_ws(":", x["taxon"].cast("string"), x["state"].cast("string"))), ",")
    return sites.groupBy("site").agg(column.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def site_summary(sites: DataFrame) -> DataFrame:
    """``site, n_taxa, n_states, steps, constant, informative``: informative if two states occur twice or more."""
    counts = sites.groupBy("site", "state").agg(F.count("*").alias("n"))
    per = counts.groupBy("site").agg(F.sum("n").alias("n_taxa"), F.count("*").alias("n_states"), F.sum((F.col("n") > 1).cast("long")).alias("twice"))
    return per.select("site", "n_taxa", "n_states", (F.col("n_states") - 1).alias("steps"), (F.col("n_states") == 1).alias("constant"), (F.col("twice") > 1).alias("informative"))


def majority_characters(sites: DataFrame) -> DataFrame:
    """Binary characters of an alignment: 0 for the column's most frequent state (ties: the lowest), 1 for another."""
    counts = sites.groupBy("site", "state").agg(F.count("*").alias("n"))
    top = counts.groupBy("site").agg(F.max_by("state", F.struct("n", -F.col("state"))).alias("major"))
    return sites.join(top, "site").select("taxon", F.col("site").alias("char"), (F.col("state") != F.col("major")).cast("int").alias("state"))


TAXA4 = ("t1", "t2", "t3", "t4")


def quartet_patterns(sites: DataFrame) -> DataFrame:
    """``t1 < t2 < t3 < t4, pattern, n``: how many sites that all four have show each of the 256 columns, ``pattern`` being the four states in base 4, first
    taxon first. Columns that don't occur have no row.

    Quartets meet once in a block of 64 sites, and a count is the number of common bits of four masks.
    """
    masks = site_masks(sites, 4)
    named = [masks.select("block", F.col("taxon").alias(t), F.array(*(f"m{k}" for k in range(4))).alias(f"x{t}")) for t in TAXA4]
    met = named[0]
    for before, own, t in zip(TAXA4, named[1:], TAXA4[1:], strict=False):
        met = met.join(own, "block").where(F.col(before) < F.col(t))

    def common(pattern: Column) -> Column:
        digits = [F.floor(pattern / 4**k).cast("int") % 4 for k in (3, 2, 1, 0)]
        out = None
        for t, digit in zip(TAXA4, digits, strict=True):
            own = F.get(f"x{t}", digit)
            out = own if out is None else out.bitwiseAND(own)
        return F.struct(pattern.alias("pattern"), F.bit_count(out).alias("n"))

    each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(255)), common), lambda x: x["n"] > 0)
    return met.select(*TAXA4, F.inline(each)).groupBy(*TAXA4, "pattern").agg(F.sum("n").alias("n"))


def _kinds(kind) -> dict[tuple[int, int, int], list[int]]:
    """Patterns that are xxyy, xyxy and xyyx, as ``kind`` sees states."""
    digits = {p: [p >> k & 3 for k in (6, 4, 2, 0)] for p in range(256)}
    alike = ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))
    kinds = {p: [kind(s) for s in d] for p, d in digits.items()}
    return {order: [p for p, s in kinds.items() if s[order[0]] == s[order[1]] != s[order[2]] == s[order[3]]] for order in alike}


def _quartet_counts(sites: DataFrame, wanted: list[list[int]]) -> DataFrame:
    """``t1 .. t4, n1 ..``: sites that show one of each list of patterns; quartets without common sites have no row."""
    sums = (F.sum(F.when(F.col("pattern").isin(own), F.col("n")).otherwise(0)).cast("long").alias(f"n{k}") for k, own in enumerate(wanted, 1))
    return quartet_patterns(sites).groupBy(*TAXA4).agg(*sums)


def lake_support(sites: DataFrame) -> DataFrame:
    """Transversion patterns that support each of a quartet's three trees, the best one (ties: the first) and the chi-square against equal thirds."""
    crossing = _kinds(lambda s: s % 2)  # the same order of columns, but only those whose two states are a purine and a pyrimidine
    counted = _quartet_counts(sites, [[p for p in own if p in crossing[order]] for order, own in _kinds(lambda s: s).items()])
    n, top = F.col("n1") + F.col("n2") + F.col("n3"), F.greatest("n1", "n2", "n3")
    best = F.when(F.col("n1") == top, 1).when(F.col("n2") == top, 2).otherwise(3)
    chi = sum((F.pow(F.col(f"n{k}") - n / 3, 2) / (n / 3) for k in (1, 2, 3)), F.lit(0.0))
    return counted.select("*", best.alias("best"), F.round(F.when(n > 0, chi), 6).alias("chi_square"))


def cavender(sites: DataFrame) -> DataFrame:
    """Purine-pyrimidine patterns and the quadratic invariants' differences; the best tree has the least in absolute value."""
    counted = _quartet_counts(sites, list(_kinds(lambda s: s % 2).values()))
    found = counted.select("*", (F.col("n2") - F.col("n3")).alias("d1"), (F.col("n1") - F.col("n3")).alias("d2"), (F.col("n1") - F.col("n2")).alias("d3"))
    least = F.least(*(F.abs(f"d{k}") for k in (1, 2, 3)))
    return found.withColumn("best", F.when(F.abs("d1") == least, 1).when(F.abs("d2") == least, 2).otherwise(3))


def compatible_pairs(chars: DataFrame) -> DataFrame:
    """``a, b, n_gametes, compatible`` of pairs of binary characters with a common taxon: at most three of the four state pairs occur.

    A character is two masks for each block of 64 taxa (numbered in any order), so a pair is made once a block, not once a taxon.
    """
    numbered = chars.select("taxon").distinct()
    rank = counted(running_count(numbered, "taxon"))
    bit = F.expr("shiftleft(1L, cast(pmod(k, 64) AS int))")
    has = lambda s: F.bit_or(F.when(F.col("state") == s, bit).otherwise(F.lit(0).cast("long")))
    masks = chars.join(rank, "taxon").groupBy("char", F.floor(F.col("k") / 64).alias("block")).agg(has(0).alias("m0"), has(1).alias("m1"))
    x, y = (masks.select("block", F.col("char").alias(c), F.col("m0").alias(f"{c}0"), F.col("m1").alias(f"{c}1")) for c in ("a", "b"))
    pairs = ((p, q, F.col(f"a{p}").bitwiseAND(F.col(f"b{q}")) != 0) for p in (0, 1) for q in (0, 1))
    gametes = sum((F.when(met, 1 << (2 * p + q)).otherwise(0) for p, q, met in pairs), F.lit(0))
    seen = x.join(y, "block").where("a < b").groupBy("a", "b").agg(F.bit_or(gametes).alias("gametes")).where("gametes > 0")
    n = F.bit_count("gametes")
    return seen.select("a", "b", n.cast("long").alias("n_gametes"), (n <= 3).alias("compatible"))


def compatible_degree(chars: DataFrame) -> DataFrame:
    """How many other characters each is compatible with."""
    pairs = compatible_pairs(chars).select(F.explode(F.array("a", "b")).alias("char"), F.col("compatible").cast("long").alias("n"))
    return pairs.groupBy("char").agg(F.sum("n").alias("degree"))


def running_count(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``k``, distinct numbers from 0 without gaps: rows are dealt by their hashes, and each part counts on from the parts before it."""
    dealt = rows.withColumn("_range", F.pmod(F.xxhash64(order), F.lit(4096)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # at most 4096
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.join(F.broadcast(before), "_range").withColumn("k", F.col("_before") + inside).drop("_range", "_before")


def first_join(d: DataFrame) -> DataFrame:
    """The pair that neighbour joining joins first: least (n - 2) d - r_i - r_j, ties by the pair."""
    both = d.select("i", "j", "d").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    r = both.groupBy("i").agg(F.sum("d").alias("r"))
    n = r.agg(F.count("*").alias("n"))
    q = d.join(r.withColumnRenamed("r", "ri"), "i").join(r.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j").join(F.broadcast(n))
    q = q.select("i", "j", F.round((F.col("n") - 2) * F.col("d") - F.col("ri") - F.col("rj"), 4).alias("q"))
    return q.orderBy("q", "i", "j").limit(1)

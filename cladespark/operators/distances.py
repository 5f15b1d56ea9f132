"""Pairwise evolutionary distances as column expressions over one shared aggregation of state pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = range(4)
TRANSITIONS = ((0, 2), (2, 0), (1, 3), (3, 1))


def site_masks(sites: DataFrame, n_states: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, taxon, block, m0 ..``: of each block of 64 sites, which ones have each state, as bits. ``keys``: columns that tell alignments apart."""
    bit = F.expr("shiftleft(1L, cast(pmod(site, 64) AS int))")
    masks = (F.bit_or(F.when(F.col("state") == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(n_states))
    return sites.groupBy(*keys, "taxon", F.floor(F.col("site") / 64).alias("block")).agg(*masks)


def _paired(sites: DataFrame, n_states: int, keys: Sequence[str] = ()) -> DataFrame:
    """Masks of every two taxa of a block: ``i < j`` with ``x0 ..`` and ``y0 ..``."""
    masks = site_masks(sites, n_states, keys)
    x = masks.select(*keys, F.col("taxon").alias("i"), "block", *(F.col(f"m{k}").alias(f"x{k}") for k in range(n_states)))
    y = masks.select(*keys, F.col("taxon").alias("j"), "block", *(F.col(f"m{k}").alias(f"y{k}") for k in range(n_states)))
    return x.join(y, [*keys, "block"]).where("i < j")


def pair_counts(sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, i, j`` (i < j) and the counts ``c<a><b>`` of sites where i has state a and j has b; sites that either lacks don't count. ``sites``: a row for each taxon and site.

    Taxa meet by an equi-join on a block of 64 sites, and a count is the number of common bits of two masks, so pairs are made once for 64 sites.
    The counts are summed before the shuffle, which then has a row per pair and task.
    """
    common = lambda a, b: F.sum(F.bit_count(F.col(f"x{a}").bitwiseAND(F.col(f"y{b}"))).cast("long")).alias(f"c{a}{b}")
    counted = _paired(sites, len(BASES), keys).groupBy(*keys, "i", "j").agg(*(common(a, b) for a in BASES for b in BASES))
    return counted.where(total() > 0)


def _sum(pairs) -> Column:
    return sum((F.col(f"c{a}{b}") for a, b in pairs), F.lit(0))


def total() -> Column:
    return _sum((a, b) for a in BASES for b in BASES)


def same() -> Column:
    return _sum((a, a) for a in BASES)


def ts() -> Column:
    """Transitions."""
    return _sum(TRANSITIONS)


def tv() -> Column:
    """Transversions."""
    return total() - same() - ts()


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def _gamma(x: Column, alpha: float) -> Column:
    """What stands in a distance for -ln x when rates vary by a gamma distribution."""
    return F.when(x > 0, alpha * (F.pow(x, -1 / alpha) - 1))


def _minus_log(x: Column, alpha: float | None) -> Column:
    return -_log(x) if alpha is None else _gamma(x, alpha)


def jc69(alpha: float | None = None) -> Column:
    return 0.75 * _minus_log((4 * same() / total() - 1) / 3, alpha)


def k2p(alpha: float | None = None) -> Column:
    return 0.5 * _minus_log(1 - 2 * ts() / total() - tv() / total(), alpha) + 0.25 * _minus_log(1 - 2 * tv() / total(), alpha)


def pair_frequencies() -> list[Column]:
    return [(_sum((k, b) for b in BASES) + _sum((a, k) for a in BASES)) / (2 * total()) for k in BASES]


def _frequencies(fixed: Sequence[float] | None) -> list[Column]:
    """Given frequencies, at least 1e-6 each, as shares of their sum; or the pair's own."""
    if fixed is None:
        return pair_frequencies()
    held = [max(float(p), 1e-6) for p in fixed]
    return [F.lit(p / sum(held)) for p in held]


def f81(alpha: float | None = None, frequencies: Sequence[float] | None = None) -> Column:
    rest = 1 - sum((p * p for p in _frequencies(frequencies)), F.lit(0.0))
    return rest * _minus_log(1 - F.try_divide(1 - same() / total(), rest), alpha)


def _f84_parts(frequencies: Sequence[float] | None = None) -> tuple[Column, Column, Column]:
    pa, pc, pg, pt = _frequencies(frequencies)
    purine, pyrimidine = pa + pg, pc + pt
    return F.try_divide(pc * pt, pyrimidine) + F.try_divide(pa * pg, purine), pc * pt + pa * pg, purine * pyrimidine


def f84(alpha: float | None = None, frequencies: Sequence[float] | None = None) -> Column:
    a, b, c = _f84_parts(frequencies)
    p, q = ts() / total(), tv() / total()
    return 2 * a * _minus_log(1 - F.try_divide(p, 2 * a) - F.try_divide((a - b) * q, 2 * a * c), alpha) - 2 * (a - b - c) * _minus_log(1 - F.try_divide(q, 2 * c), alpha)


def f84_uncorrected() -> Column:
    """A variant found in older software, which doesn't reduce to K2P at equal frequencies."""
    a, b, c = _f84_parts()
    return -2 * a * _log(1 - F.try_divide(c * ts() / total(), 2 * a)) - 2 * (a - b) * _log(1 - F.try_divide(tv() / total(), 2 * c))


def determinant4(m: list[list[Column]]) -> Column:
    """Laplace expansion along the first two rows."""
    minor = lambda r, s, i, j: m[r][i] * m[s][j] - m[r][j] * m[s][i]
    pairs = [(i, j) for i in BASES for j in BASES if i < j]
    out = F.lit(0.0)
    for i, j in pairs:
        k, n = (x for x in BASES if x not in (i, j))
        out = out + (-1) ** (i + j + 1) * minor(0, 1, i, j) * minor(2, 3, k, n)
    return out


def logdet() -> Column:
    share = [[F.col(f"c{a}{b}") / total() for b in BASES] for a in BASES]
    rows = [_sum((a, b) for b in BASES) / total() for a in BASES]
    columns = [_sum((a, b) for a in BASES) / total() for b in BASES]
    edges = sum((_log(x) for x in (*rows, *columns)), F.lit(0.0))
    d = (-_log(determinant4(share)) + 0.5 * edges) / 4
    return F.when((d < 0) & (d > -1e-10), 0.0).otherwise(d)


MODELS = {"jc69": jc69, "k2p": k2p, "f81": f81, "f84": f84}


def distances(counts: DataFrame, d: Column) -> DataFrame:
    """``i, j, d``; ``d`` is null where the model has no finite distance."""
    return counts.select("i", "j", F.round(d, 6).alias("d"))


def transition_ratio(counts: DataFrame) -> DataFrame:
    """Transitions over transversions of all pairs, within 0.5 and 20; 2 without transversions."""
    sums = counts.agg(F.sum(ts()).alias("ts"), F.sum(tv()).alias("tv"))
    ratio = F.when(F.col("tv") == 0, 2.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(20.0), F.col("ts") / F.col("tv"))))
    return sums.select("ts", "tv", F.round(ratio, 6).alias("ratio"))


def paired_masks(sites: DataFrame, n_states: int) -> DataFrame:
    """``i, j, block, same, total``: of each block of 64 sites, where taxa i < j have the same state, and where both have any, as bits."""
    same = _union([F.col(f"x{k}").bitwiseAND(F.col(f"y{k}")) for k in range(n_states)])
    both = _union([F.col(f"x{k}") for k in range(n_states)]).bitwiseAND(_union([F.col(f"y{k}") for k in range(n_states)]))
    return _paired(sites, n_states).select("i", "j", "block", same.alias("same"), both.alias("total"))


def state_pairs(sites: DataFrame, n_states: int = 20) -> DataFrame:
    """``i, j, same, total`` for states below ``n_states``."""
    same = sum((F.bit_count(F.col(f"x{k}").bitwiseAND(F.col(f"y{k}"))) for k in range(n_states)), F.lit(0))
    both = F.bit_count(_union([F.col(f"x{k}") for k in range(n_states)]).bitwiseAND(_union([F.col(f"y{k}") for k in range(n_states)])))
    return _paired(sites, n_states).groupBy("i", "j").agg(F.sum(same.cast("long")).alias("same"), F.sum(both.cast("long")).alias("total")).where("total > 0")


def _union(masks: list[Column]) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out.bitwiseOR(m)
    return out


def protein(method: str) -> Column:
    """Poisson, Kimura, or PAM units (100 times Kimura) over ``same, total``."""
    p = 1 - F.col("same") / F.col("total")
    if method == "poisson":
        return -_log(1 - p)
    kimura = -_log(1 - p - 0.2 * p * p)
    return 100 * kimura if method == "pam" else kimura


def restriction(characters: DataFrame, length: int = 6) -> DataFrame:
    """Nei-Li distances of presence/absence of restriction sites: ``i, j, d``."""
    x = characters.select(F.col("taxon").alias("i"), "char", F.col("state").alias("a"))
    y = characters.select(F.col("taxon").alias("j"), "char", F.col("state").alias("b"))
    shared = F.try_divide(2 * F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") + F.col("b")))
    counts = x.join(y, "char").where("i < j").groupBy("i", "j").agg(shared.alias("s"))
    p = 1 - F.pow("s", F.lit(1 / length))
    return counts.select("i", "j", F.round(-0.75 * _log(1 - 4 * p / 3), 6).alias("d"))


def frequency_sums(freqs: DataFrame) -> DataFrame:
    """``i, j`` and sums over loci and alleles that the gene-frequency distances share; an allele missing in a population has frequency 0."""
    x = freqs.select(F.col("pop").alias("i"), "locus", "allele", F.col("f").alias("x"))
    y = freqs.select(F.col("pop").alias("j"), "locus", "allele", F.col("f").alias("y"))
    both = x.join(y, ["locus", "allele"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.sqrt(F.col("x") * F.col("y"))).alias("root"))
    own = freqs.groupBy("pop").agg(F.sum(F.col("f") * F.col("f")).alias("ff"), F.countDistinct("locus").cast("double").alias("loci"))
    a, b = own.withColumnsRenamed({"pop": "i", "ff": "xx"}), own.select(F.col("pop").alias("j"), F.col("ff").alias("yy"))
    return both.join(a, "i").join(b, "j")


def nei() -> Column:
    return -F.log(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))


def chord() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("loci") - F.col("root")) / F.col("loci")))


def reynolds() -> Column:
    theta = (F.col("xx") + F.col("yy") - 2 * F.col("xy")) / (2 * (F.col("loci") - F.col("xy")))
    return -_log(1 - theta)


FREQUENCY_METHODS = {"nei": nei, "chord": chord, "reynolds": reynolds}


def gene_frequency_distances(freqs: DataFrame, method: str = "nei") -> DataFrame:
    return frequency_sums(freqs).select("i", "j", F.round(FREQUENCY_METHODS[method](), 6).alias("d"))



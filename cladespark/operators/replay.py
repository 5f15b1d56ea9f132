"""Draws of a seeded 64-bit linear congruential generator, each computed by its own row.

``n`` steps of a generator are one multiplication and one addition again, whose constants follow from the bits of ``n``; so a row that knows the number of its
draw needs no earlier one, and draws are spread over tasks like any other rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..session import workers_see_package

# Multiplier and increment.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
_WRAP = 1 << 64


@lru_cache
def _jumps() -> tuple[tuple[int, int], ...]:
    """Multiplier and increment of 1, 2, 4, ... steps."""
    out, a, c = [], MULTIPLIER, INCREMENT
    for _ in range(63):
        out.append((a, c))
        a, c = a * a % _WRAP, (a * c + c) % _WRAP
    return tuple(out)


def states(steps: np.ndarray, seed: int) -> np.ndarray:
    """The generator's states after so many steps from ``seed``, as unsigned 64-bit integers."""
    steps = steps.astype(np.uint64)
    out = np.full(len(steps), seed % _WRAP, np.uint64)
    for k, (a, c) in enumerate(_jumps()):
        if not len(steps) or not int(steps.max()) >> k:
            break
        moved = (steps >> np.uint64(k) & np.uint64(1)).astype(bool)
        out[moved] = out[moved] * np.uint64(a) + np.uint64(c)
    return out


def below(step: Column, n: Column, seed: int) -> Column:
    """The draw of a step (1: the first) from 0 to ``n`` - 1: the state modulo ``n``."""

    @pandas_udf("long")
    def draw(step: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series((states(step.to_numpy(), seed) % n.to_numpy().astype(np.uint64)).astype(np.int64))

    return draw(step, n)


def uniform(step: Column, seed: int) -> Column:
    """The draw of a step from [0, 1): the first 53 bits of the state."""

    @pandas_udf("double")
    def draw(step: pd.Series) -> pd.Series:
        return pd.Series((states(step.to_numpy(), seed) >> np.uint64(11)).astype(float) / float(1 << 53))

    return draw(step)


def seeded_weights(spark: SparkSession, n_sites: int, reps: int, seed: int = 42, block: int = 1, fraction: float = 1.0) -> DataFrame:
    """``rep, pos, w``: how often each site is drawn with replacement in replicates 1 to ``reps`` of one run of the generator.

    ``block``: sites in a row, around the end, that a draw takes; ``fraction``: of the sites, how many are drawn. Sites that aren't drawn have no row; without sites, or
    with a block longer than what is drawn, there are none.
    """
    workers_see_package(spark)
    block = max(1, block)
    draws = int(n_sites * min(max(fraction, 0.0), 1.0) + 0.5) // block
    drawn = spark.range(reps * draws).select((F.floor(F.col("id") / max(draws, 1)) + 1).cast("int").alias("rep"), (F.col("id") + 1).alias("step"))
    start = drawn.select("rep", below(F.col("step"), F.lit(max(n_sites, 1)).cast("long"), seed).alias("pos"))
    if block > 1:
        start = start.select("rep", F.explode(F.sequence(F.col("pos"), F.col("pos") + (block - 1))).alias("at")).select("rep", (F.col("at") % n_sites).alias("pos"))
    return start.groupBy("rep", "pos").agg(F.count("*").alias("w"))


def shuffled(names: list[str], seed: int) -> list[str]:
    """The names in the order of a seeded exchange shuffle from the last place down; its generator starts at ``seed`` + 1."""
    out = list(names)
    drawn = states(np.arange(1, len(out)), seed + 1)
    for step, last in enumerate(range(len(out) - 1, 0, -1)):
        k = int(drawn[step]) % (last + 1)
        out[last], out[k] = out[k], out[last]
    return out

"""Amino-acid steps of the standard genetic code: fewest base changes between codons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The standard code, codons in the order of TCAG for each base; amino acids in alphabetical order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def codons(spark: SparkSession) -> DataFrame:
    """``aa, b0, b1, b2`` of the sense codons."""
    k = F.col("id")
    found = spark.range(64).select(F.substr(F.lit(CODE), (k + 1).cast("int"), F.lit(1)).alias("aa"), F.floor(k / 16).alias("b0"), (F.floor(k / 4) % 4).alias("b1"), (k % 4).alias("b2"))
    return found.where("aa <> '*'")


def steps(spark: SparkSession) -> DataFrame:
    """``a, b, step`` for all pairs of amino acids."""
    x, y = codons(spark), codons(spark)
    x, y = (f.select(F.col("aa").alias(n), *(F.col(f"b{k}").alias(f"{n}{k}") for k in range(3))) for f, n in ((x, "a"), (y, "b")))
    apart = sum(((F.col(f"a{k}") != F.col(f"b{k}")).cast("long") for k in range(3)), F.lit(0).cast("long"))
    return x.join(F.broadcast(y)).groupBy("a", "b").agg(F.min(apart).alias("step"))


def steps_sql() -> str:
    codon = f"SELECT substr('{CODE}', k::INTEGER + 1, 1) AS aa, k // 16 AS b0, k // 4 % 4 AS b1, k % 4 AS b2 FROM (SELECT unnest(generate_series(0, 63)) AS k)"
    return f"SELECT x.aa AS a, y.aa AS b, min((x.b0 <> y.b0)::BIGINT + (x.b1 <> y.b1)::BIGINT + (x.b2 <> y.b2)::BIGINT) AS step FROM ({codon}) x, ({codon}) y WHERE x.aa <> '*' AND y.aa <> '*' GROUP BY ALL"

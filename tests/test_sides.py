import hashlib
from collections import Counter

from cladespark import encode
from cladespark.operators import resampling
from cladespark.operators.sides import tasks_for

SF = "/root/testdata/sf0.001"


def test_rows_of_a_task_stay_bounded(spark, monkeypatch):
    assert [tasks_for(spark, n, 1000) for n in (0, 1, 200, 4_000, 400_000)] == [1, 1, 4, 4, 400]
    monkeypatch.setattr(encode, "SALES_ROWS", 500)
    lines = encode.table(spark, SF, "lineitem").count()
    sizes = encode.sites(spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == -(-lines // 500) and max(sizes) < 1000


def test_draws_are_dealt_out_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DRAWS", 100)
    for n, size in ((150, 1), (157, 10)):
        sites = spark.range(n).select("id").withColumnRenamed("id", "pos")
        kind = "boot" if size == 1 else "block"
        found = resampling.bootstrap_weights(sites, 5) if size == 1 else resampling.block_weights(sites, 5, size)
        draw = lambda rep, pos: int(hashlib.md5(f"{kind}:{rep}:{pos}".encode()).hexdigest()[:8], 16) % n  # noqa: E731, B023
        want = Counter((rep, (draw(rep, pos) + k) % n) for rep in range(1, 6) for pos in range(n // size) for k in range(size))
        assert {(r.rep, r.pos): r.w for r in found.collect()} == want
        assert found.rdd.getNumPartitions() == -(-5 * n // 100)


def test_joins_of_sales_are_dealt_out_by_rows(spark, monkeypatch):
    """However few partitions a shuffle has, a task gets a bounded number of rows, and the rows are the same."""
    sf, columns = "/root/testdata/sf0.001", ["taxon", "region", "site", "q", "rq"]
    want = sorted(map(tuple, encode.sales(spark, sf).select(columns).collect()))
    monkeypatch.setattr(encode, "JOIN_ROWS", 100)
    monkeypatch.setattr(encode, "SALES_ROWS", 500)
    assert sorted(map(tuple, encode.sales(spark, sf).select(columns).collect())) == want
    line = encode.table(spark, sf, "lineitem").select("l_orderkey")
    order = encode.table(spark, sf, "orders").select("o_orderkey")
    sizes = line.count(), order.count()
    found = encode.dealt_join(line, order, "l_orderkey", "o_orderkey", sizes)
    assert found.rdd.getNumPartitions() == -(-sizes[0] // 100) and found.count() == sizes[0]

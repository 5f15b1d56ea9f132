import pytest

from cladespark.functions.newick import explode_trees
from cladespark.operators import distances as D
from cladespark.sources import formats as S
from cladespark.sources import reports as R

from .test_kernels import DNA5

FASTA = "# note\n" + "".join(f">{n} more words\n{s[:5]} {s[5:]}\n\n" for n, s in DNA5.items())


def test_fasta():
    assert S.fasta(FASTA) == list(DNA5.items())
    assert S.fasta(">a\nmk*j\n", protein=True) == [("a", "MKXX")]
    for bad in ("", "ACGT", ">a\nAC!\n", ">a\nAC\n>b\nA\n"):
        with pytest.raises(S.FormatError):
            S.fasta(bad)


def test_phylip():
    sequential = " 2 8\nAlpha     ACGT\nACGT\nBeta      ACGTACGA\n"
    interleaved = " 2 8\nAlpha     ACGT\nBeta      ACGT\n\nACGT\nACGA\n"
    want = [("Alpha", "ACGTACGT"), ("Beta", "ACGTACGA")]
    assert S.phylip(sequential) == S.phylip(interleaved) == want
    for bad in ("x", " 3 8\nAlpha     ACGTACGT\n", " 1 9\nAlpha     ACGT\n"):
        with pytest.raises(S.FormatError):
            S.phylip(bad)


def test_matrices():
    square = "3\nA         0 1 2\nB         1 0\n3\nC         2 3 0\n"
    lower = "3\nA\nB         1\nC         2 3\n"
    want = [("A", "B", 1.0), ("A", "C", 2.0), ("B", "C", 3.0)]
    assert S.distance_matrix(square) == S.distance_matrix(lower) == want
    assert S.distance_matrix(S.write_distances(want)) == want
    assert S.binary_matrix("2 3\nA         0 1 1\nB         110\n") == [("A", "011"), ("B", "110")]
    with pytest.raises(S.FormatError):
        S.binary_matrix("1 2\nA         02\n")


def test_files_to_distances(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.fasta").write_text(FASTA)
    S.register(spark)
    rows = spark.read.format("fasta").load(str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, S.read(spark, "fasta", str(tmp_path)).collect()))
    sites = S.to_sites(rows.where("aln_id = '0.fasta'"))
    found = {(r.i[0], r.j[0]): r.d for r in D.distances(D.pair_counts(sites), D.jc69()).collect()}
    want = {"AB": 0.275794, "AD": 0.949250, "AE": 1.288239, "BC": 0.275794, "DE": 0.172181, "AG": 0.539342, "BG": 0.275794}
    assert found["Alpha"[0], "B"] == pytest.approx(want["AB"]) and found["A", "G"] == pytest.approx(want["AG"])
    assert found["D", "E"] == pytest.approx(want["DE"]) and found["A", "E"] == pytest.approx(want["AE"])


def test_trees_as_rows(spark):
    trees = spark.createDataFrame([(1, "((A:1,B:2):0.5,C);"), (2, "(A,"), (3, None)], "tree int, newick string")
    got = sorted(map(tuple, explode_trees(trees).collect()))
    assert [r[1:] for r in got] == [(0, None, 0, None, None, 0), (1, 0, 0, None, 0.5, 1), (2, 1, 0, "A", 1.0, 2), (3, 1, 1, "B", 2.0, 2), (4, 0, 1, "C", None, 1)]


def test_reports(spark, tmp_path):
    distances = spark.createDataFrame([("x", "A", "B", 1.5), ("x", "A", "Long name of it", 2.0), ("x", "B", "Long name of it", 0.25)], "aln_id string, i string, j string, d double")
    text = R.distance_text(distances).first().text
    assert S.distance_matrix(text) == [("A", "B", 1.5), ("A", "Long name", 2.0), ("B", "Long name", 0.25)]
    trees = spark.createDataFrame([("x", "((A:1,B:2):0.5,C,D);", -7.5), ("y", "(", None)], "aln_id string, newick string, lnl double")
    found = {r.aln_id: r.text for r in R.tree_text(trees, value="lnl").collect()}
    assert found["x"].splitlines()[:2] == ["tree: ((A:1,B:2):0.5,C,D);", "lnl: -7.5"] and len(found["x"].splitlines()) == 7
    assert [tuple(r) for r in R.clades(trees).collect()] == [("x", "A,B", 0.5)]
    lnl = spark.createDataFrame([("t", -1.0), ("t", -3.0)], "tree string, lnl double")
    assert tuple(R.site_summary(lnl).first()) == ("t", 2, -4.0, -3.0, -2.0, -1.0)
    assert [r.value for r in R.as_json(lnl).collect()] == ['{"tree":"t","lnl":-1.0}', '{"tree":"t","lnl":-3.0}']
    R.save_text(R.distance_text(distances), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_writers(spark, tmp_path):
    S.register(spark)
    sequences = spark.createDataFrame([(a, n, s) for a in ("x", "y") for n, s in DNA5.items()], "aln_id string, taxon string, seq string").repartition(4)
    for kind in ("phylip", "fasta"):
        out = str(tmp_path / kind)
        S.save(sequences, kind, out)
        assert sorted(map(tuple, spark.read.format(kind).load(out).collect())) == sorted(map(tuple, sequences.collect()))
        with pytest.raises(Exception, match="exists"):
            S.save(sequences, kind, out)
        S.save(sequences.where("aln_id = 'x'"), kind, out, mode="overwrite")
        assert {p.name for p in (tmp_path / kind).iterdir()} == {"x"}
    distances = spark.createDataFrame([("m", "A", "B", 1.5), ("m", "A", "C", 2.0), ("m", "B", "C", 0.25)], "aln_id string, i string, j string, d double")
    S.save(distances, "distmat", str(tmp_path / "d"))
    assert sorted(map(tuple, spark.read.format("distmat").load(str(tmp_path / "d")).collect())) == sorted(map(tuple, distances.collect()))


def test_failed_writes_leave_nothing(spark, tmp_path):
    S.register(spark)
    out = tmp_path / "out"
    unequal = spark.createDataFrame([("a", "A", "ACGT"), ("a", "B", "ACGT"), ("b", "A", "ACG"), ("b", "B", "A")], "aln_id string, taxon string, seq string")
    with pytest.raises(Exception, match="unequal"):
        S.save(unequal, "fasta", str(out))
    spread = spark.createDataFrame([("a", n, "ACGT") for n in "ABCDEFGH"], "aln_id string, taxon string, seq string").repartition(4, "taxon")
    with pytest.raises(Exception, match="more than one task"):
        spread.write.format("phylip").mode("append").save(str(out))
    with pytest.raises(Exception, match="columns"):
        spread.drop("seq").write.format("phylip").mode("append").save(str(out))
    assert not out.exists() or not list(out.iterdir())


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    S.register(spark)
    text = "# note\n" + "".join(f">name{k} more\n{'ACGT' * 5}\n\n{'TTGCA' * 4}\n" for k in range(40))
    (tmp_path / "big.fasta").write_text(text)
    want = [("big.fasta", *r) for r in S.fasta(text)]
    for size in (1, 7, 50, 333, 100_000):
        rows = spark.read.format("fasta").option("maxPartitionBytes", size if size > 1 else 29).load(str(tmp_path / "big.fasta"))
        assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert rows.rdd.getNumPartitions() == 1
    assert spark.read.format("fasta").option("maxPartitionBytes", 333).load(str(tmp_path / "big.fasta")).rdd.getNumPartitions() > 5
    lines = "30 8\n" + "".join(f"{f'taxon{k}':<10}ACGT ACG{'ACGT'[k % 4]}\n" for k in range(30))
    (tmp_path / "big.phy").write_text(lines)
    for size in (20, 64, 500):
        rows = spark.read.format("phylip").option("maxPartitionBytes", size).load(str(tmp_path / "big.phy"))
        assert sorted(map(tuple, rows.collect())) == sorted(("big.phy", *r) for r in S.phylip(lines))
    (tmp_path / "odd.fasta").write_text(text + ">last\nAC\n")
    with pytest.raises(Exception, match="unequal"):
        spark.read.format("fasta").option("maxPartitionBytes", 333).load(str(tmp_path / "odd.fasta")).count()


def test_ambiguous_bases_from_a_file(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nARN-u\n>y\nacgtb\n")
    found = {(r.taxon, r.site): r["mask"] for r in S.to_masks(S.read(spark, "fasta", str(tmp_path))).collect()}
    assert found == {("x", 0): 1, ("x", 1): 5, ("x", 4): 8, ("y", 0): 1, ("y", 1): 2, ("y", 2): 4, ("y", 3): 8, ("y", 4): 14}


def test_records_by_the_text_reader(spark, tmp_path):
    text = "# note\n\n" + "".join(f">name{k} more\r\n{'ACGT' * 5} 20\n# inside\n\nttgca{'TTGCA' * 3}\n" for k in range(40))
    (tmp_path / "a.fasta").write_text(text)
    (tmp_path / "b.fasta").write_text(FASTA)
    (tmp_path / "c.fasta").write_text(FASTA.removeprefix("# note\n"))
    want = sorted([("a.fasta", *r) for r in S.fasta(text)] + [(f, *r) for f in ("b.fasta", "c.fasta") for r in S.fasta(FASTA)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "777", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = S.read_fasta(spark, str(tmp_path))
            assert sorted(map(tuple, rows.collect())) == want
            assert rows.rdd.getNumPartitions() > 10 or size != "100"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.fasta").write_text(">a\nmk*j\n")
    assert [tuple(r) for r in S.read_fasta(spark, str(tmp_path / "p"), protein=True).collect()] == [("x.fasta", "a", "MKXX")]
    for k, bad in enumerate(("ACGT", ">a\nAC!\n", ">a\nAC\n>b\nA\n")):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "x.fasta").write_text(bad)
        with pytest.raises(Exception, match="unequal|no base"):
            S.read_fasta(spark, str(tmp_path / f"bad{k}")).collect()

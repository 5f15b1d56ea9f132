import numpy as np
import pandas as pd
import pytest

from cladespark.functions import likelihood as L
from cladespark.functions.newick import parse
from cladespark.plans import models

SF = "/root/testdata/sf0.001"


def test_part_of_a_simulation():
    tree = parse("((A:0.1,B:0.3):0.05,C:0.2,D:0.4);")
    model = L.Model((0.1, 0.2, 0.3, 0.4), 2.0)
    whole = L.simulate(tree, 1000, model, 5)
    for part in ((0, 1000), (130, 517), (999, 1000)):
        assert all(np.array_equal(v, whole[k][slice(*part)]) for k, v in L.simulate(tree, 1000, model, 5, part).items())


def test_windows_over_blocks_are_those_over_all_sites(spark):
    """Blocks, narrower than a window or wider than the alignment, give what one array of all sites gives."""
    rows = pd.DataFrame([tuple(r) for r in models.region_sites(spark, SF).collect()], columns=["taxon", "site", "state"])
    masks = {str(t): g.set_index("site")["state"].map(lambda x: 1 << x).reindex(sorted(rows["site"].unique()), fill_value=15).to_numpy() for t, g in rows.groupby("taxon")}
    data = L.Data.of(masks)
    n, names = len(data.pattern_of_site), sorted(masks)
    tree, _ = models._start(names, data)

    def low(data):
        site = L.pattern_lnl(tree, data, L.Model())[data.pattern_of_site]
        return (np.convolve(site, np.ones(20), "valid") - 20 * site.mean()).min()

    observed = low(data)
    for node in tree.postorder():
        node.length = max(node.length or 0.0, 1e-6)
    p = np.mean([low(L.Data.of(L.simulate(tree, n, L.Model(), k))) <= observed for k in range(1, 7)])
    for block in (13, 64, 4096):
        got = models.plato_bootstrap(spark, SF, reps=6, size=20, block=block).collect()
        assert [tuple(r) for r in got] == [(pytest.approx(observed, abs=1e-4), pytest.approx(p))]

"""The exact null of U against enumeration, and which batches use it."""

from itertools import combinations
from math import comb
from statistics import NormalDist

import numpy as np
import pytest

from cellshift.operators import de
from cellshift.session import materialize
from tests.test_pipeline import _brute_z, _build, _obs


def _enumerated(n1: int, n2: int) -> np.ndarray:
    """Arrangements of n1 among n1 + n2 places by their U."""
    ways = np.zeros(n1 * n2 + 1, dtype=np.int64)
    for places in combinations(range(n1 + n2), n1):
        ways[sum(places) - n1 * (n1 - 1) // 2] += 1
    return ways


@pytest.mark.parametrize("small", range(1, 9))
def test_exact_null_equals_enumeration(small):
    for large in range(small, 9):
        ways = _enumerated(small, large)
        p = de.exact_p(small, large)
        assert len(p) == small * large // 2 + 1
        for k in range(len(p)):
            assert p[k] == pytest.approx(min(1.0, 2 * ways[: k + 1].sum() / ways.sum()), rel=1e-14)


def test_exact_null_beyond_long_integers():
    """Whole numbers of any size: both ends are known in closed form, and p never falls."""
    p = de.exact_p(8, 3000)
    assert comb(3008, 8) > 1 << 62
    assert p[0] == pytest.approx(2 / comb(3008, 8), rel=1e-14) and p[3] == pytest.approx(2 * (1 + 1 + 2 + 3) / comb(3008, 8), rel=1e-14)
    assert (np.diff(p) >= 0).all() and p[-1] == 1.0


def _two_sided(u: float, n1: int, n2: int) -> float:
    ways = _enumerated(n1, n2)
    return min(1.0, 2 * ways[: int(min(u, n1 * n2 - u)) + 1].sum() / ways.sum())


def test_small_batches_without_ties_are_exact(spark):
    """p0: exact. p1: one tie in one gene, so no gene of it. p2: more than 8 on both sides. p3: one zero, no tie."""
    sizes = {"p0": (5, 7), "p1": (5, 7), "p2": (9, 10), "p3": (3, 8)}
    rows = [("A", name, dose, plate, 24.0) for plate, n in sizes.items() for name, dose, k in (("d", 1.0, n[0]), ("control", 0.0, n[1])) for _ in range(k)]
    obs = _obs(rows)
    x = np.random.default_rng(7).uniform(0.5, 3.0, (len(rows), 6))
    plate, treated = obs.plate.to_numpy(), (obs.compound == "d").to_numpy()
    p1 = np.flatnonzero(plate == "p1")
    x[p1[-1], 2] = x[p1[0], 2]
    x[np.flatnonzero(plate == "p3")[0], 4] = 0.0
    b = _build(spark, obs, x, n_hvg=6)
    names = {r.gene_idx: r.gene_id for r in b.genes.collect()}
    buckets = de.bucket_sums(de.value_histogram(b.placed_expression))
    seen = {}
    for r in de.plate_z(buckets, b.matching, b.n_genes, materialize).collect():
        g, here = names[r.gene_idx], plate == r.eff_batch
        u, z = _brute_z(x[here & treated, g], x[here & ~treated, g])
        assert r.u == pytest.approx(u)
        if r.eff_batch in ("p0", "p3"):
            assert r.p == pytest.approx(_two_sided(u, *sizes[r.eff_batch]), rel=1e-12)
            assert abs(r.z) == pytest.approx(abs(NormalDist().inv_cdf(r.p / 2)), abs=1e-12)
            assert r.z == 0 or np.sign(r.z) == np.sign(x[here & treated, g].mean() - x[here & ~treated, g].mean())
        else:
            assert r.p is None and r.z == pytest.approx(z)
        seen[r.eff_batch] = seen.get(r.eff_batch, 0) + 1
    assert seen == dict.fromkeys(sizes, 6)


def test_the_histogram_is_exchanged_once(spark):
    """Behind its own count one exchange by bucket, from which windows and sums both come."""
    rows = [("A", "control", 0.0, "p0", 24.0)] * 30 + [("A", "d", 1.0, "p0", 24.0)] * 20
    x = np.round(np.random.default_rng(3).uniform(0, 3, (50, 5)), 1)
    b = _build(spark, _obs(rows), x, n_hvg=5)
    hist = materialize(de.value_histogram(b.placed_expression), "histogram")
    plan = de.bucket_sums(hist)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_values_of_one_side_alone(spark):
    """Genes of controls only, of treated cells only, and buckets that one side holds alone."""
    rows = [("A", "control", 0.0, "p0", 24.0)] * 15 + [("A", "d", 1.0, "p0", 24.0)] * 12
    x = np.round(np.random.default_rng(5).uniform(0.1, 4, (27, 4)), 2)
    x[:15, 0], x[15:, 1], x[:15, 2], x[15:, 3] = 0.0, 0.0, x[:15, 2] + 9, x[15:, 3] + 9
    b = _build(spark, _obs(rows), x, n_hvg=4)
    names = {r.gene_idx: r.gene_id for r in b.genes.collect()}
    found = b.plate_z.collect()
    for r in found:
        u, z = _brute_z(x[15:, names[r.gene_idx]], x[:15, names[r.gene_idx]])
        assert r.u == pytest.approx(u) and r.z == pytest.approx(z)
    assert len(found) == 4

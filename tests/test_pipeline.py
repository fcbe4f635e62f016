"""Cell-level pipeline on small hand-made assays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellshift.config import Config
from cellshift.functions import keyed
from cellshift.functions.quantiles import exact_percentiles
from cellshift.operators import de, halves, pseudobulk, qc
from cellshift.plans.dataset import Build
from tests.fixtures import assay_from_dense


def _obs(rows):
    return pd.DataFrame(rows, columns=["cell_line", "compound", "dose", "plate", "time"])


def _build(spark, obs, x, **config):
    genes = [f"G{i}" for i in range(x.shape[1])]
    cfg = Config(**{**dict(min_genes=0, min_cells_per_condition=5, n_hvg=3, n_ceiling_reps=3), **config})
    return Build(assay_from_dense(spark, obs, x, genes, already_normalized=True), cfg)


@pytest.fixture(scope="module")
def two_plates(spark):
    """70/30 plates with controls at 1 and 5, plus a third plate without controls, and a late time point."""
    rng = np.random.default_rng(0)
    rows, level = [], []
    for plate, n, base in (("p0", 40, 1.0), ("p1", 40, 5.0)):
        rows += [("A", "control", 0.0, plate, 24.0)] * n
        level += [base] * n
    for plate, n in (("p0", 70), ("p1", 30), ("p2", 20)):
        rows += [("A", "d|1", 10.0, plate, 24.0)] * n
        level += [10.0] * n
    rows += [("A", "d|1", 10.0, "p0", 72.0)] * 12
    level += [20.0] * 12
    x = np.clip(np.array(level)[:, None] + rng.normal(0, 0.01, (len(rows), 6)), 0, None)
    return _build(spark, _obs(rows), x), np.array(level), rows, x


def test_plate_weighting_and_dropped_plate(two_plates):
    b, _, _, _ = two_plates
    got = {r.time: r for r in b.profiles.collect()}
    assert got[24.0].n_cells == 100 and got[24.0].batch == "p0,p1"
    assert np.allclose(got[24.0].control, 0.7 * 1 + 0.3 * 5, atol=0.05)
    assert np.allclose(got[24.0].delta, 7.8, atol=0.05)
    assert np.allclose(np.array(got[24.0].x) - got[24.0].control, got[24.0].delta)
    assert np.mean(got[72.0].delta) > np.mean(got[24.0].delta) + 2
    s = pseudobulk.plate_summary(b.matching, 5).first()
    assert s.n_cells_dropped_plate_no_control == 20 and s.n_condition_plate_pairs_dropped_no_control == 1
    assert s.n_conditions_multi_plate == 1 and s.modal_plate_purity_mean == pytest.approx((0.7 + 1) / 2)


def test_condition_ids_stay_unique_with_bars(two_plates):
    b, _, _, _ = two_plates
    ids = [r.cond_id for r in b.obs.collect()]
    assert len(set(ids)) == 2 and all("d\\|1" in i for i in ids)


def test_too_few_cells(spark, two_plates):
    _, _, rows, x = two_plates
    b = _build(spark, _obs(rows), x, min_cells_per_condition=1000)
    assert b.profiles.count() == 0
    assert pseudobulk.plate_summary(b.matching, 1000).first().n_conditions_dropped_too_few_cells == 2


def test_halves_average_to_delta(two_plates):
    b, _, _, _ = two_plates
    delta = {r.cond_id: np.array(r.delta) for r in b.profiles.collect()}
    rows = b.halves().collect()
    assert len(rows) == 2 * 3
    for r in rows:
        assert np.allclose((np.array(r.h0) + np.array(r.h1)) / 2, delta[r.cond_id], atol=0.05)


def test_single_cell_plates_have_null_halves(spark):
    rows = [("A", "control", 0.0, "p0", 24.0)] * 3 + [("A", "d", 1.0, "p0", 24.0)]
    b = _build(spark, _obs(rows), np.ones((4, 2)), min_cells_per_condition=1)
    assert all(r.h0 is None and r.h1 is None for r in b.halves().collect())


def _brute_z(t, c):
    both = np.concatenate([t, c])
    n1, n2 = len(t), len(c)
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    u = rank[:n1].sum() - n1 * (n1 + 1) / 2
    _, counts = np.unique(both, return_counts=True)
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - (counts**3 - counts).sum() / (n * (n - 1)))
    z = 0.0 if var <= 0 else max(0.0, (abs(u - n1 * n2 / 2) - 0.5) / np.sqrt(var))
    return u, z * (-1 if t.mean() < c.mean() else 1)


def test_rank_sums_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = ([("A", "control", 0.0, "p0", 24.0)] * 37 + [("A", "control", 0.0, "p1", 24.0)] * 25
            + [("A", "d0", 1.0, "p0", 24.0)] * 21 + [("A", "d0", 1.0, "p1", 24.0)] * 9 + [("A", "d1", 1.0, "p0", 24.0)] * 12)
    obs = _obs(rows)
    x = np.round(np.clip(rng.normal(0.3, 1, (len(rows), 8)), 0, None), 1)  # zeros and ties
    x[:, 7] = 0.0
    b = _build(spark, obs, x, n_hvg=8)
    names = {r.gene_idx: r.gene_id for r in b.genes.collect()}
    seen = 0
    for r in b.plate_z.collect():
        compound = r.cond_id.split("|")[1]
        here = (obs.plate == r.eff_batch).to_numpy()
        g = names[r.gene_idx]
        u, z = _brute_z(x[here & (obs.compound == compound).to_numpy(), g], x[here & (obs.compound == "control").to_numpy(), g])
        assert r.u == pytest.approx(u) and r.z == pytest.approx(z)
        seen += 1
    assert seen == 3 * 7  # the all-zero gene has no rows


def test_de_is_not_the_largest_change(spark):
    rng = np.random.default_rng(2)
    rows = [("A", "control", 0.0, "p0", 24.0)] * 200 + [("A", "d", 1.0, "p0", 24.0)] * 200
    x = np.abs(rng.normal(10, 1, (400, 20)))
    x[:, 0] = np.abs(rng.normal(400, 120, 400))  # large and noisy
    x[200:, 0] += 5
    x[:, 1] = rng.normal(5, 0.05, 400)
    x[200:, 1] += 0.5
    b = _build(spark, _obs(rows), x, de_alpha=0.01)
    delta = np.abs(np.array(b.profiles.first().delta))
    found = b.de.first().de
    assert delta.argmax() == 0 and 0 not in found and 1 in found


def test_bh_matches_step_up(spark):
    from math import erfc, sqrt

    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 40)
    frame = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(z)], "cond_id string, gene_idx int, z double")
    got = {r.gene_idx for r in de.de_genes(frame, 50, 0.05).collect()}
    p = np.array([erfc(abs(v) / sqrt(2)) for v in z] + [1.0] * 10)
    order = np.argsort(p)
    passed = np.flatnonzero(p[order] <= 0.05 * np.arange(1, 51) / 50)
    assert got == set(order[: passed.max() + 1].tolist()) and got


def test_qc_without_mito_keeps_all(spark):
    assay = assay_from_dense(spark, _obs([("A", "d", 1.0, "p", 0.0)] * 10), np.ones((10, 5)), [f"G{i}" for i in range(5)])
    stats = qc.cell_stats(assay, Config(min_genes=1))
    row = qc.qc_summary(stats, Config(min_genes=1)).first()
    assert not row.mito_filter_applied and row.n_cells_after_qc == 10 and row.mito_median is None


def test_input_kind(spark):
    rng = np.random.default_rng(0)
    long = lambda m: spark.createDataFrame(
        [(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "cell_id long, gene_id int, count double")
    assert qc.detect_input_kind(long(rng.poisson(50, (20, 10)))).first().detected_input == "raw_counts"
    assert qc.detect_input_kind(long(np.abs(rng.normal(2, 1, (20, 10))))).first().detected_input == "already_normalized_or_log"


def test_percentiles_and_keyed_ranks(spark):
    values = np.random.default_rng(5).exponential(10, 3000).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = exact_percentiles(frame, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert np.allclose(got, np.percentile(values, [10, 50, 99]))
    keyed_frame = frame.withColumn("g", F.col("i") % 2).withColumn("key", keyed.digest(0, "t", "i"))
    flat, deep = (keyed.keyed_rank(keyed_frame, ["g"], "key", d).select("i", "rank") for d in (0, 2))
    assert flat.exceptAll(deep).isEmpty()
    cut = keyed.keyed_cutoff(keyed_frame.withColumn("take", F.lit(400)), ["g"], "key", "take", 2)
    assert {r["count"] for r in keyed_frame.join(cut, "g").where("key <= cutoff").groupBy("g").count().collect()} == {400}

"""Folds, predictors, metrics and normalisation."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellshift.config import Config
from cellshift.operators import baselines, hvg, metrics, normalize, pooling, ridge, splits
from cellshift.plans.sweep import Sweep

PROFILE = "cond_id string, cell_line string, compound string, dose double, log_dose double, target string, x array<double>, control array<double>, delta array<double>"


def _profiles(spark, rows):
    """rows: (line, compound, dose, control, delta[, target])"""
    out = []
    for line, compound, dose, control, delta, *target in rows:
        c, d = [float(v) for v in control], [float(v) for v in delta]
        out.append((f"{line}|{compound}|{dose}", line, compound, float(dose), float(np.log1p(dose)), (target or ["unknown"])[0],
                    [a + b for a, b in zip(c, d)], c, d))
    return spark.createDataFrame(out, PROFILE)


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(0)
    base = {line: rng.normal(2, 1, 12) for line in ("A", "B", "C")}
    effect = {f"d{i}": rng.normal(0, 1, 12) for i in range(6)}
    target = {"d0": "T1", "d1": "T1", "d2": "T2"}
    rows = [
        (line, drug, dose, base[line] + rng.normal(0, 0.05, 12), effect[drug] * np.log1p(dose) / 3 + rng.normal(0, 0.2, 12), target.get(drug, "unknown"))
        for line in base for drug in effect for dose in (10.0, 100.0)
    ]
    return _profiles(spark, rows).cache()


@pytest.fixture(scope="module")
def folds(grid):
    return splits.all_folds(grid, 0).cache()


def test_fold_shapes(grid, folds):
    per = {(r.regime, r.fold): r for r in folds.groupBy("regime", "fold").agg(
        F.count_if(F.col("role") == "test").alias("te"), F.count_if(F.col("role") == "train").alias("tr")).collect()}
    assert per[("random", "random/holdout")].te == 7  # round(36 * 0.2)
    context = [k for k in per if k[0] == "held_out_context"]
    assert len(context) == 3 and all(per[k].te == 12 and per[k].tr == 24 for k in context)
    drug = folds.where("regime = 'held_out_drug' AND role = 'test'").join(grid, "cond_id").select("fold", "compound").distinct().collect()
    where = {r.compound: r.fold for r in drug}
    assert where["d0"] == where["d1"] and len(where) == 6
    both = folds.where("regime = 'held_out_both'").groupBy("fold").count().collect()
    assert len(both) == 3 * 5


def test_unknown_regime_and_columns(grid):
    with pytest.raises(ValueError):
        splits.make_folds(grid, "other", 0)
    with pytest.raises(ValueError):
        splits.make_folds(grid.drop("dose"), "random", 0)


def test_no_annotation_makes_singletons(grid):
    groups = splits.compound_groups(grid.withColumn("target", F.lit("unknown"))).collect()
    assert not any(r.available for r in groups) and all(r.group == r.compound for r in groups)


def test_leakage_checks(grid, folds):
    meta = splits.fold_meta(grid, folds, 0)
    assert splits.assert_no_leakage(grid, folds, meta) == 1 + 3 + 5 + 15
    leak = folds.where("fold = 'held_out_context/A' AND role = 'test'").limit(1).withColumn("role", F.lit("train"))
    with pytest.raises(AssertionError, match="held_out_context/A"):
        splits.assert_no_leakage(grid, folds.unionByName(leak), meta)
    silent = meta.withColumn("held_out_cell_lines", F.array().cast("array<string>"))
    checks = {r.check for r in splits.leakage_violations(grid, folds, silent).collect()}
    assert checks == {"test_line_not_declared"}
    lost = folds.limit(1).withColumn("cond_id", F.lit("nowhere"))
    assert "unknown_condition" in {r.check for r in splits.leakage_violations(grid, folds.unionByName(lost), meta).collect()}


def test_gene_selection_ignores_test_rows(grid, folds):
    fold = folds.where("fold = 'held_out_context/A'")
    before = hvg.select_genes(hvg.fold_gene_variance(grid, fold), 4, 12).orderBy("gene_idx").collect()
    wild = grid.withColumn("x", F.when(F.col("cell_line") == "A", F.transform("x", lambda v: v * 1e6)).otherwise(F.col("x")))
    assert hvg.select_genes(hvg.fold_gene_variance(wild, fold), 4, 12).orderBy("gene_idx").collect() == before
    # the check has teeth: letting test rows in does change the variances
    leaky = hvg.fold_gene_variance(wild, fold.withColumn("role", F.lit("train"))).agg(F.max("var")).first()[0]
    assert leaky > 1e6 > hvg.fold_gene_variance(wild, fold).agg(F.max("var")).first()[0]
    x = np.array([r.x for r in grid.where("cell_line <> 'A'").orderBy("cond_id").collect()])
    assert [r.gene_idx for r in before] == sorted(np.argsort(x.var(0))[-4:].tolist())


def test_uncovered_genes_raise(spark):
    want = spark.createDataFrame([("f", 3)], "fold string, gene_idx int")
    have = spark.createDataFrame([(0,), (2,), (5,)], "gene_idx int")
    with pytest.raises(AssertionError):
        hvg.assert_covered(want, have)


def _fit(profiles, folds, n=None):
    width = n or len(profiles.first().x)
    return baselines.Fit(profiles, folds, hvg.all_genes(folds, width))


def _fold(spark, train, test):
    rows = [("random", "f", c, "train") for c in train] + [("random", "f", c, "test") for c in test]
    return spark.createDataFrame(rows, "regime string, fold string, cond_id string, role string")


def test_tiers(spark):
    p = _profiles(spark, [
        ("A", "x", 10, [1] * 3, [1, 2, 3]), ("B", "x", 10, [1] * 3, [3, 4, 5]), ("B", "x", 100, [1] * 3, [8, 8, 8]),
        ("C", "x", 10, [1] * 3, [0] * 3), ("C", "x", 1, [1] * 3, [0] * 3), ("C", "new", 10, [1] * 3, [0] * 3),
    ])
    f = _fold(spark, ["A|x|10", "B|x|10", "B|x|100"], ["C|x|10", "C|x|1", "C|new|10"])
    got = {r.cond_id: r for r in baselines.per_drug_mean_delta(_fit(p, f)).collect()}
    assert got["C|x|10"].pred == [2, 3, 4] and got["C|x|10"].tier == 0
    assert np.allclose(got["C|x|1"].pred, [4, 14 / 3, 16 / 3]) and got["C|x|1"].tier == 1  # mean of conditions
    assert got["C|new|10"].fallback and got["C|new|10"].tier == 2 and np.allclose(got["C|new|10"].pred, got["C|x|1"].pred)
    rates = {r.baseline: r for r in baselines.fallback_rates(baselines.predict_all(_fit(p, f), ["per_drug_mean_delta", "no_change"])).collect()}
    assert rates["per_drug_mean_delta"].fallback_rate == pytest.approx(1 / 3)
    assert rates["no_change"].fallback_rate_dose_collapsed is None


def test_nearest_context_copies_similar_line(spark):
    p = _profiles(spark, [("A", "x", 10, [1, 1, 1], [5] * 3), ("B", "x", 10, [-1, -1, -1], [-5] * 3), ("C", "x", 10, [2, 2, 2], [0] * 3)])
    f = _fold(spark, ["A|x|10", "B|x|10"], ["C|x|10"])
    row = baselines.nearest_context(_fit(p, f)).first()
    assert row.pred == [5, 5, 5] and row.tier == 0 and not row.fallback


def _dense_ridge(control, delta, compounds, log_dose, cv, control_t, compounds_t, log_dose_t, onehot):
    """Textbook version: explicit indicator columns and one solve per alpha."""
    n = len(control)
    mean = control.mean(0)
    _, s, vt = np.linalg.svd(control - mean, full_matrices=False)
    wanted = max(1, min(50, n - 1, control.shape[1]))
    keep = max(1, int(((s**2 / (s**2).sum())[:wanted] > 1e-6).sum()))
    w = vt[:keep] / (s[:keep, None] / np.sqrt(n - 1))
    names = sorted(set(compounds))
    sd = log_dose.std()
    sd = sd if sd > 1e-12 else 1.0

    def feats(c, comp, ld):
        cols = [(c - mean) @ w.T]
        if onehot:
            cols.append(np.array([[float(k == q) for q in names] for k in comp]))
        return np.hstack([*cols, ((ld - log_dose.mean()) / sd)[:, None]])

    def fit(x, y, a):
        xm, ym = x.mean(0), y.mean(0)
        b = np.linalg.solve((x - xm).T @ (x - xm) + a * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
        return lambda z: (z - xm) @ b + ym

    x = feats(control, compounds, log_dose)
    scores = []
    for a in ridge.ALPHAS:
        scores.append(np.mean([-np.mean((fit(x[cv != k], delta[cv != k], a)(x[cv == k]) - delta[cv == k]) ** 2) for k in np.unique(cv)]))
    alpha = ridge.ALPHAS[int(np.argmax(scores))]
    return alpha, keep, fit(x, delta, alpha)(feats(control_t, compounds_t, log_dose_t))


@pytest.mark.parametrize("use_compound", [True, False])
def test_ridge_matches_dense_solution(grid, folds, use_compound):
    two = folds.where("fold IN ('held_out_context/A', 'held_out_drug/fold1')")
    genes = hvg.gene_lists(hvg.all_genes(two, 12))
    whole = {(r.fold, r.cond_id): r for r in ridge.ridge_predictions(grid, two, genes, use_compound).collect()}
    sharded = {(r.fold, r.cond_id): r for r in ridge.ridge_predictions(grid, two, genes, use_compound, rows_per_shard=7).collect()}
    rows = {(r.fold, r.cond_id): r for r in ridge._rows(grid, two, genes, 1).collect()}
    meta = {r.cond_id: r for r in grid.collect()}
    assert whole.keys() == sharded.keys() and len(whole) == two.where("role = 'test'").count()
    for fold in ("held_out_context/A", "held_out_drug/fold1"):
        train = sorted(c for (f, c), r in rows.items() if f == fold and r.train)
        test = sorted(c for (f, c), r in rows.items() if f == fold and not r.train)
        col = lambda ids, k: np.array([getattr(meta[c], k) for c in ids])
        cv = np.array([rows[(fold, c)].cv for c in train])
        sizes = np.bincount(cv)
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
        alpha, keep, want = _dense_ridge(
            col(train, "control"), col(train, "delta"), col(train, "compound"), col(train, "log_dose"), cv,
            col(test, "control"), col(test, "compound"), col(test, "log_dose"), use_compound)
        seen = set(col(train, "compound"))
        for c, w in zip(test, want):
            for got in (whole[(fold, c)], sharded[(fold, c)]):
                assert np.allclose(got.pred, w, atol=1e-8) and got.alpha == alpha and got.n_components == keep
                assert got.fallback == (use_compound and meta[c].compound not in seen)


def test_ridge_survives_rank_deficient_controls(spark):
    rng = np.random.default_rng(4)
    base = {line: rng.normal(2, 1, 200) for line in "ABCD"}
    rows = [(line, f"d{i}", 10.0 * (i + 1), base[line] + rng.normal(0, 1e-8, 200), rng.normal(0, 0.3, 200)) for line in "ABCD" for i in range(7)]
    p = _profiles(spark, rows)
    f = splits.make_folds(p, "held_out_context", 0).where("fold = 'held_out_context/D'")
    got = ridge.ridge_predictions(p, f, hvg.gene_lists(hvg.all_genes(f, 200)), True).collect()
    assert {r.n_components for r in got} == {2}
    assert max(np.abs(r.pred).max() for r in got) < 10


def test_non_finite_values_raise():
    with pytest.raises(FloatingPointError):
        ridge.check_finite(np.array([1.0, np.nan]), "test")
    with pytest.raises(RuntimeError):
        ridge.whitening(np.zeros((3, 3)), 5)


# --- metrics ---------------------------------------------------------------------------------

PAIR = "fold string, baseline string, target string, rep int, cond_id string, pred array<double>, truth array<double>, control array<double>, de array<double>"


def _pairs(spark, pred, truth, control=None, de=None):
    n, g = truth.shape
    control = np.zeros((n, g)) if control is None else control
    de = np.ones((n, g)) if de is None else de
    rows = [("f", "b", metrics.FULL, -1, f"c{i:03d}", pred[i].tolist(), truth[i].tolist(), control[i].tolist(), de[i].astype(float).tolist()) for i in range(n)]
    pairs = spark.createDataFrame(rows, PAIR)
    return pairs, pairs.select("fold", "target", "rep", "cond_id", "truth", "control")


def _scored(spark, *args, **kw):
    pairs, pools = _pairs(spark, *args, **kw)
    rows = metrics.score_conditions(pairs, pools).collect()
    return {rep: sorted((r for r in rows if r.representation == rep), key=lambda r: r.cond_id) for rep in metrics.REPRESENTATIONS}


def _naive_ranks(pred, truth):
    out = []
    for i in range(len(pred)):
        d = np.sqrt(((truth - pred[i]) ** 2).sum(1))
        out.append(((d < d[i]).sum() + ((d == d[i]).sum() - 1) / 2) / (len(pred) - 1))
    return out


def test_metric_values(spark):
    rng = np.random.default_rng(6)
    truth, control = rng.normal(0, 0.3, (12, 30)), rng.normal(5, 2, (12, 30))
    pred = truth + rng.normal(0, 0.2, truth.shape)
    pred[0], pred[1] = truth[0], -truth[1]
    pred[2] = 0.0
    de = np.zeros((12, 30))
    de[3, :10], de[4, :1] = 1, 1
    got = _scored(spark, pred, truth, control, de)
    d, a = got["delta"], got["absolute"]
    assert d[0].pearson_r == pytest.approx(1) and d[1].pearson_r == pytest.approx(-1)
    assert d[2].pearson_r is None and a[2].pearson_r > 0.9  # inflation by the control profile
    assert d[3].pearson_r_de == pytest.approx(np.corrcoef(pred[3, :10], truth[3, :10])[0, 1])
    assert d[3].direction_acc_de == pytest.approx(np.mean(np.sign(pred[3, :10]) == np.sign(truth[3, :10])))
    assert d[4].pearson_r_de is None and d[5].direction_acc_de is None
    for i in range(12):
        assert d[i].mae == pytest.approx(np.abs(pred[i] - truth[i]).mean())
        if i > 2:
            assert a[i].pearson_r == pytest.approx(np.corrcoef(control[i] + pred[i], control[i] + truth[i])[0, 1])
    assert np.allclose([r.pert_discrimination for r in d], _naive_ranks(pred, truth))
    assert np.allclose([r.pert_discrimination for r in a], _naive_ranks(pred + control, truth + control))


def test_rank_counts_equal_plain_distances():
    """Every comparison, exact ties too, as by measuring each prediction against each truth; lattices, far offsets, equal predictions, undefined ones."""
    rng = np.random.default_rng(7)
    for trial in range(200):
        n, m, g, scale = int(rng.integers(1, 50)), int(rng.integers(1, 50)), int(rng.integers(1, 30)), 10.0 ** rng.integers(-6, 7)
        truths = rng.normal(size=(n, g)) * scale + (1e3 * rng.normal(size=g) if trial % 5 == 1 else 0)
        if trial % 5 == 2:
            truths = np.round(truths / scale) * scale
        truths = truths[rng.integers(0, n, n)]
        own = truths[rng.integers(0, n, m)]
        pred = np.zeros_like(own) if trial % 5 == 3 else own + rng.normal(size=own.shape) * scale
        if trial % 5 == 2:
            pred = np.round(pred / scale) * scale
        if trial % 5 == 4:
            pred[0] = np.nan
            truths[-1, 0] = np.inf
        with np.errstate(invalid="ignore", over="ignore"):
            nearer, tied = metrics.rank_counts(pred, own, truths)
            for i in range(m):
                d = np.sqrt(((np.vstack([truths, own[i : i + 1]]) - pred[i]) ** 2).sum(axis=1))
                assert (nearer[i], tied[i]) == ((d[:-1] < d[-1]).sum(), (d[:-1] == d[-1]).sum()), (trial, i)


def test_unknown_representation_is_refused(spark):
    pairs = spark.createDataFrame([], "fold string, baseline string, target string, rep int, cond_id string, pred array<double>, truth array<double>, control array<double>, de array<double>")
    with pytest.raises(ValueError, match="representation"):
        metrics.score_conditions(pairs, pairs, representations=("relative",))


def test_discrimination_ties_across_blocks(spark):
    rng = np.random.default_rng(7)
    truth = np.repeat(rng.normal(0, 1, (10, 20)), 5, axis=0)  # groups of five equal truths
    pred = truth + rng.normal(0, 0.1, truth.shape)
    for p in (pred, np.zeros_like(truth), truth):
        pairs, pools = _pairs(spark, p, truth)
        for blocks in (None, 4):
            rows = metrics.pert_discrimination(pairs, pools, blocks).where("representation = 'delta'").orderBy("cond_id").collect()
            assert np.allclose([r.pert_discrimination for r in rows], _naive_ranks(p, truth))


def test_identical_predictions_score_half_and_single_row_is_undefined(spark):
    truth = np.random.default_rng(8).normal(0, 1, (10, 15))
    got = _scored(spark, np.zeros_like(truth), truth)["delta"]
    assert np.mean([r.pert_discrimination for r in got]) == pytest.approx(0.5)
    assert _scored(spark, truth[:1], truth[:1])["delta"][0].pert_discrimination is None


def test_representation_is_checked():
    with pytest.raises(ValueError):
        metrics.check_representation("other")


def test_aggregate(spark):
    rows = [("m", 0.1), ("m", 0.5), ("m", 0.9), ("m", None), ("one", 2.0), ("none", None)]
    got = {r.k: r for r in metrics.aggregate(spark.createDataFrame(rows, "k string, v double"), ["k"]).collect()}
    assert (got["m"].n, got["m"].n_skipped) == (3, 1) and got["m"].std == pytest.approx(0.4)
    assert got["one"].std == 0.0 and got["none"].mean is None and got["none"].std is None


def test_bootstrap(spark):
    values = np.random.default_rng(9).normal(3, 1, 200)
    rows = [("g", i, float(v)) for i, v in enumerate(values)] + [("one", 0, 4.0), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    first = {r.k: (r.ci_low, r.ci_high) for r in metrics.bootstrap_ci(frame, ["k"], ["i"], 0).collect()}
    again = {r.k: (r.ci_low, r.ci_high) for r in metrics.bootstrap_ci(frame.repartition(7), ["k"], ["i"], 0).collect()}
    assert first == again and first["one"] == (4.0, 4.0) and first["none"] == (None, None)
    assert first["g"][0] < values.mean() < first["g"][1]
    old, metrics.SHARD_RANKS = metrics.SHARD_RANKS, 64  # many shards: the same interval
    try:
        many = [(r.ci_low, r.ci_high) for r in metrics.bootstrap_ci(frame.where("k = 'g'"), ["k"], ["i"], 0).collect()][0]
    finally:
        metrics.SHARD_RANKS = old
    assert np.allclose(many, first["g"], rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [2, 63, 64, 65, 200, 1000])
def test_draw_tree(n):
    """Every resample draws n of n values; any cut of the ranks gives the same weights; their spread is a multinomial's."""
    whole = np.concatenate(list(metrics.draw_weights(11, n, 4000, 0, n)), axis=1)
    assert whole.shape == (4000, n) and (whole.sum(axis=1) == n).all()
    cut = [np.concatenate(list(metrics.draw_weights(11, n, 4000, a, min(n, a + 128))), axis=1) for a in range(0, n, 128)]
    assert np.array_equal(np.concatenate(cut, axis=1), whole)
    assert abs(whole.mean(axis=0) - 1).max() < 0.1 and abs(whole.var(axis=0) - (1 - 1 / n)).max() < 0.2
    pairs = np.cov(whole[:, [0, n - 1]].T)[0, 1]
    assert abs(pairs + 1 / n) < 0.1
    assert not np.array_equal(whole, np.concatenate(list(metrics.draw_weights(12, n, 4000, 0, n)), axis=1))


def test_bootstrap_matches_plain_resampling(spark):
    """The interval of a skewed sample against a resampling in numpy."""
    values = np.random.default_rng(4).exponential(2, 300)
    frame = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    got = metrics.bootstrap_ci(frame, ["k"], ["i"], 3, n_boot=4000).first()
    plain = values[np.random.default_rng(5).integers(0, 300, (4000, 300))].mean(axis=1)
    assert np.allclose([got.ci_low, got.ci_high], np.percentile(plain, [2.5, 97.5]), atol=0.04)


def test_direction_guard(spark):
    rows = [("mae", 0.03, 0.04, 0.035), ("mae", 0.05, 0.01, 0.03), ("pearson_r", 0.5, 0.3, 0.4), ("pearson_r", 0.2, 0.9, 0.9),
            ("pearson_r", 0.4, 0.4, 0.4), ("pearson_r", None, 0.4, 0.4)]
    frame = spark.createDataFrame([(i, m, f, c, v, 0.1) for i, (m, f, c, v) in enumerate(rows)],
                                  "i int, metric string, floor_value double, ceiling_value double, value double, std double")
    got = [(r.normalization_valid, r.normalized) for r in normalize.with_guard(frame).orderBy("i").collect()]
    assert got[0] == (False, None) and got[2] == (False, None) and got[4] == (True, None) and got[5] == (True, None)
    assert got[1][0] and got[1][1] == pytest.approx(0.5) and got[3] == (True, 1.0)


def test_pooling(spark):
    rows = [("k", 0.2, 0.1, 10), ("k", 0.6, 0.3, 30), ("k", 0.9, 0.0, 1), ("k", None, None, 0), ("s", 0.5, 0.0, 1)]
    got = {r.k: r for r in pooling.pool(spark.createDataFrame(rows, "k string, value double, std double, n_conditions long"), ["k"]).collect()}
    n, v = np.array([10, 30, 1.0]), np.array([0.2, 0.6, 0.9])
    s = np.array([0.1, 0.3, (10 * 0.1 + 30 * 0.3) / 40])
    mean = (n * v).sum() / n.sum()
    assert got["k"].mean == pytest.approx(mean) and got["k"].n == 41
    assert got["k"].std == pytest.approx(np.sqrt((n * (s**2 + (v - mean) ** 2)).sum() / n.sum()))
    assert (got["s"].mean, got["s"].std, got["s"].n) == (0.5, 0.0, 1)


def test_sweep_on_identical_halves(spark, grid):
    """Equal halves make a perfect ceiling; the floor normalises to 0 and the ceiling to 1."""
    half = grid.select("cond_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"), F.col("delta").alias("h0"), F.col("delta").alias("h1"))
    de = grid.select("cond_id", F.array(F.lit(1), F.lit(4), F.lit(7)).alias("de"))
    data = SimpleNamespace(cfg=Config(n_hvg=8), profiles=grid, de=de, n_genes=12, halves=lambda genes: half)
    sweep = Sweep(data, regimes=("held_out_context",))
    res = sweep.results(n_boot=20).toPandas()
    assert list(res.columns) == normalize.RESULTS_COLUMNS and len(res) == 3 * 6 * 5 * 2 * 2
    top = res[(res.baseline == "ceiling") & (res.metric == "pearson_r")]
    assert np.allclose(top.value, 1) and np.allclose(top.normalized, 1) and (top.n_conditions == 24).all() and (top.n_test == 12).all()
    floor = res[(res.baseline == "no_change") & (res.metric == "mae")]
    assert np.allclose(floor.normalized, 0)
    assert res[(res.baseline == "no_change") & (res.metric == "pearson_r") & (res.representation == "delta")].value.isna().all()
    again = sweep.results(n_boot=20).toPandas()
    keys = normalize.SORT_KEYS
    a, b = res.sort_values(keys).reset_index(drop=True), again.sort_values(keys).reset_index(drop=True)
    assert np.allclose(a.ci_low, b.ci_low, equal_nan=True) and np.allclose(a.value, b.value, equal_nan=True)

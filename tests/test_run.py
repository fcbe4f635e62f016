"""The whole program on the order tables at the smallest scale."""

import json
import os

import numpy as np
import pytest

from cellshift.config import Config
from cellshift.plans.run import run

SOURCE = "/root/testdata/sf0.001"
LIMITS = {"folds_per_regime": 2, "genes_per_fold": 200}


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="order tables not present")
def test_run_resume_and_report(spark, tmp_path):
    cfg = Config(dataset="orders", min_genes=2, min_cells_per_condition=8, n_hvg=15, n_ceiling_reps=2,
                 cache_dir=str(tmp_path / "cache"), out_dir=str(tmp_path / "out"))
    results, meta = run(spark, cfg, SOURCE, n_boot=20, **LIMITS, regimes=["random"])
    first = results.toPandas()
    assert len(first) == 120 and meta["n_folds"] == meta["n_leakage_checks"] == 1
    csv = lambda: b"".join(p.read_bytes() for p in sorted((tmp_path / "out" / "results.csv").glob("part-*")))
    before = csv()
    assert before.count(b"\n") == 121
    resumed, meta = run(spark, cfg, SOURCE, n_boot=20, **LIMITS, resume=True, regimes=["random"])
    assert resumed.count() == 120 and csv() == before  # nothing recomputed, byte-identical export
    report = (tmp_path / "out" / "report.md").read_text()
    for heading in ("Floor policy", "Direction guard", "Main table", "Secondary table", "held_out_context", "Absolute against delta",
                    "normalised mae", "ridge on held_out_context", "quality control", "Four questions"):
        assert heading in report
    saved = json.loads((tmp_path / "out" / "run_meta.json").read_text())
    assert saved["config"]["seed"] == 0 and saved["dataset_meta"]["n_genes_total"] == 25 and "pyspark" in saved["versions"]


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="order tables not present")
def test_broken_run_resumes_at_the_missing_fold(spark, tmp_path, monkeypatch):
    from cellshift.operators import baselines
    from cellshift.streaming.results_log import ResultsLog

    cfg = Config(dataset="orders", min_genes=2, min_cells_per_condition=8, n_hvg=15, n_ceiling_reps=2,
                 cache_dir=str(tmp_path / "cache"), out_dir=str(tmp_path / "out"))
    monkeypatch.setitem(baselines.PREDICTORS, "own", baselines.no_change)
    append, calls = ResultsLog.append, []

    def breaking(self, rows):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("executor storage lost")
        append(self, rows)

    monkeypatch.setattr(ResultsLog, "append", breaking)
    options = dict(n_boot=10, regimes=["held_out_context"], folds_per_regime=2)
    with pytest.raises(OSError):
        run(spark, cfg, SOURCE, **options)
    committed = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*.parquet")}
    assert committed
    results, meta = run(spark, cfg, SOURCE, resume=True, **options)
    rows = results.toPandas()
    assert rows.fold.nunique() == 2 and meta["n_leakage_checks"] == 2 and "own" in set(rows.baseline)
    assert all(p.stat().st_mtime_ns == t for p, t in committed.items())
    both = rows[rows.baseline.isin(["own", "no_change"])].pivot_table(index=["fold", "metric", "representation", "target"], columns="baseline", values="value")
    assert len(both) and np.allclose(both["own"], both["no_change"], rtol=0, atol=1e-12, equal_nan=True)  # sums add up in shuffle order; undefined values alike

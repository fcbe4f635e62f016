"""Command line: python -m cellshift.plans.run --config configs/default.yaml --source PATH [--out-dir DIR] [--resume]
[--folds-per-regime N] [--genes-per-fold N]"""

from __future__ import annotations

import argparse
import json
import platform
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cellshift.config import Config
from cellshift.operators import splits
from cellshift.operators.normalize import FLOOR_BASELINE
from cellshift.plans.report import build_report
from cellshift.plans.sweep import Sweep
from cellshift.session import clear_tables, get_spark, ship, write_text
from cellshift.sources.cache import content_key, load_dataset
from cellshift.streaming.results_log import ResultsLog


def _git(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=5)
        return done.stdout.strip() or None
    except OSError:
        return None


def provenance(cfg: Config, limits: dict, resume: bool) -> dict:
    import numpy
    import pandas
    import pyspark

    return {
        "config": cfg.to_dict(), "seed": cfg.seed, "limits": limits, "resume": resume,
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__},
        "git": {"head": _git("rev-parse", "HEAD"), "dirty_files": (_git("status", "--porcelain") or "").splitlines()},
    }


def run(
    spark: SparkSession, cfg: Config, source: str, out_dir: str | None = None, resume: bool = False, n_boot: int = 1000,
    regimes: list[str] | None = None, folds_per_regime: int | None = None, genes_per_fold: int | None = None,
) -> tuple[DataFrame, dict]:
    """Sweep the regimes and commit fold by fold; returns (results, run metadata).

    A regime's predictions and scores are computed together and stored; then each fold's results are
    committed on their own, so a run that breaks off is resumed at the first fold missing. Without
    `resume` the results of this configuration start anew.
    """
    ship(spark)
    out = (out_dir or cfg.out_dir).rstrip("/")
    limits = {k: v for k, v in (("folds_per_regime", folds_per_regime), ("genes_per_fold", genes_per_fold)) if v}
    meta = provenance(cfg, limits, resume)
    save = lambda: write_text(spark, f"{out}/run_meta.json", json.dumps(meta, indent=2, default=str))
    save()  # before any work, so a crash leaves a trace

    log = ResultsLog(spark, out, "_".join([content_key(spark, cfg, source), f"boot{n_boot}", *(f"{k}{v}" for k, v in limits.items())]))
    if not resume:
        log.clear()
    done = {r["fold"] for r in found.select("fold").collect()} if (found := log.completed()) is not None else set()
    data, n_checked = load_dataset(spark, cfg, source), 0
    for regime in regimes or splits.REGIMES:
        whole = Sweep(data, regimes=(regime,), **limits)
        n_checked += splits.assert_no_leakage(whole.obs, whole.folds, whole.meta)  # of resumed folds as well
        names = sorted(r["fold"] for r in whole.folds.select("fold").distinct().collect())  # lines x compound groups at most
        missing = [name for name in names if name not in done]
        if not missing:
            continue
        sweep = whole if len(missing) == len(names) else Sweep(data, regimes=(regime,), skip=log.completed().select("fold"), **limits)
        for name in missing:
            log.append(sweep.results(n_boot, fold=name))
    results = log.read(regimes)
    log.export_csv(f"{out}/results.csv", regimes)
    meta.update(
        dataset_meta=data.meta, n_conditions=data.meta["n_conditions"], n_genes_total=data.n_genes, n_ceiling_reps=data.meta["n_ceiling_reps"],
        n_folds=results.select("split", "fold").distinct().count(), n_leakage_checks=n_checked, floor_policy=FLOOR_BASELINE,
        targets=["replicate_half", "full_pseudobulk"], primary_target="replicate_half",
    )
    save()
    write_text(spark, f"{out}/report.md", build_report(results, meta))
    return results, meta


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the perturbation-response benchmark.")
    parser.add_argument("--config", default="configs/default.yaml")
    parser.add_argument("--source", required=True, help="location of the assay, passed to the dataset's loader")
    parser.add_argument("--folds-per-regime", type=int, default=None, help="only the first folds of each regime, for a trial run")
    parser.add_argument("--genes-per-fold", type=int, default=None, help="only the first genes of each fold, for a trial run")
    parser.add_argument("--n-boot", type=int, default=1000)
    parser.add_argument("--out-dir", default=None)
    parser.add_argument("--resume", action="store_true", help="skip folds already in the results table")
    args = parser.parse_args(argv)
    spark = get_spark()
    try:
        run(spark, Config.from_yaml(args.config), args.source, args.out_dir, args.resume, args.n_boot,
            folds_per_regime=args.folds_per_regime, genes_per_fold=args.genes_per_fold)
    finally:
        clear_tables(spark)


if __name__ == "__main__":
    main()

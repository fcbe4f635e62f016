"""The Markdown report: small pooled tables are collected and laid out; nothing is recomputed from cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.operators import normalize, pooling
from cellshift.operators.metrics import CEILING, FULL, HALF, METRIC_DIRECTION
from cellshift.operators.splits import REGIMES

BASELINES = ["no_change", "global_mean_delta", "per_drug_mean_delta", "ridge", "ridge_no_drug", "nearest_context"]


def fmt(x, digits: int = 3) -> str:
    if x is None or x != x:
        return "NaN"
    if isinstance(x, (bool, str)):
        return str(x)
    return str(x) if isinstance(x, int) else f"{x:.{digits}f}"


def table(header: list[str], rows: list[list]) -> str:
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join(lines + ["| " + " | ".join(fmt(c) for c in row) + " |" for row in rows])


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _grid(pooled: list[dict], metric: str, target: str, names: list[str], regimes: list[str], raw: bool) -> str:
    cells = {(r["baseline"], r["split"]): r for r in pooled if r["metric"] == metric and r["target"] == target and r["representation"] == "delta"}

    def cell(r: dict | None) -> str:
        if r is None:
            return "n/a"
        fired = " (guard fired)" if r["n_guard_fired"] else ""
        norm = "NaN" + fired if r["normalized_mean"] is None else f"{fmt(r['normalized_mean'])} ± {fmt(r['normalized_std'])}, n={r['normalized_n']}{fired}"
        return f"{fmt(r['mean'])} ± {fmt(r['std'])}, n={r['n'] or 0} [{norm}]" if raw else f"{norm} of {r['n'] or 0}"

    return table(["baseline", *regimes], [[b, *[cell(cells.get((b, s))) for s in regimes]] for b in names])


def _guard(results: DataFrame) -> str:
    census = results.transform(normalize.guard_census).first()
    if census.n_fired == 0:
        return f"## Direction guard\n\nThe guard did not fire on any of {census.n_total} combinations."
    fired = results.where(~F.col("normalization_valid")).select(
        "split", "fold", "metric", "representation", "target", "floor_value", "ceiling_value"
    ).distinct().orderBy("split", "fold", "metric", "representation", "target")
    rows = [list(r.values()) for r in _rows(fired)]
    head = ["split", "fold", "metric", "representation", "target", "floor", "ceiling"]
    return (
        f"## Direction guard\n\nFired on {census.n_fired} of {census.n_total} (fold, metric, representation, target) combinations: "
        "there the ceiling lies on the wrong side of the floor and no score is normalised.\n\n" + table(head, rows)
    )


def _floors() -> str:
    rows = [[m, d, normalize.FLOOR_BASELINE[m]] for m, d in METRIC_DIRECTION.items()]
    return "## Floor policy\n\n" + table(["metric", "direction", "floor"], rows)


def _main(pooled, names, regimes, skip) -> str:
    parts = [
        "## Main table: normalised delta scores against a replicate half\n",
        "Cells are pooled normalised mean ± deviation with the number of scored conditions that could be normalised, of all scored.\n"
        "0 is the floor, 1 the split-half ceiling. The ceiling is itself a noisy half and not a strict bound.",
    ]
    for metric in METRIC_DIRECTION:
        parts.append(f"\n### {metric}\n\n" + _grid(pooled, metric, HALF, names, regimes, raw=False))
        if metric.endswith("_de") and skip.n_test:
            parts.append(
                f"\nDefined only with two or more differential genes: {skip.n_skipped} of {skip.n_test} test exposures "
                f"({100 * skip.skip_fraction:.1f}%) are skipped, so the means cover the stronger responses."
            )
    return "\n".join(parts)


def _secondary(pooled, names, regimes) -> str:
    parts = ["## Secondary table: full pseudobulk target\n\nRaw pooled mean ± deviation, n, and [normalised]."]
    parts += [f"\n### {m}\n\n" + _grid(pooled, m, FULL, [*names, CEILING], regimes, raw=True) for m in METRIC_DIRECTION]
    return "\n".join(parts)


def _context(results: DataFrame, names) -> str:
    rows = results.where((F.col("split") == "held_out_context") & (F.col("representation") == "delta") & (F.col("target") == HALF))
    per_fold = _rows(rows.select("fold", "baseline", "metric", "normalized", "normalized_std"))
    if not per_fold:
        return "## held_out_context by cell line\n\nNo such folds were run."
    pooled = {(r["metric"], r["baseline"]): r for r in _rows(pooling.pool_normalized(rows, ["metric", "baseline"]))}
    folds = sorted({r["fold"] for r in per_fold})
    at = {(r["fold"], r["baseline"], r["metric"]): r for r in per_fold}
    parts = [f"## held_out_context by cell line\n\nOne fold per cell line ({len(folds)}); a single unusual line can dominate the pooled value."]
    for m in METRIC_DIRECTION:
        body = []
        for b in names:
            cells = [at.get((f, b, m)) for f in folds]
            if any(cells):
                p = pooled.get((m, b))
                body.append([b, *["n/a" if c is None else f"{fmt(c['normalized'])} ± {fmt(c['normalized_std'])}" for c in cells],
                             "NaN" if p is None else f"{fmt(p['mean'])} ± {fmt(p['std'])}, n={p['n']}"])
        parts.append(f"\n### {m}\n\n" + table(["baseline", *folds, "pooled"], body))
    return "\n".join(parts)


def _inflation(rows: list[dict]) -> str:
    body = [[r["split"], r["representation"], r["mean"], r["std"], r["n"]] for r in sorted(rows, key=lambda r: (r["split"], r["representation"]))]
    return (
        "## Absolute against delta\n\nno_change predicts nothing. Its pearson_r is undefined on deltas and, on absolute "
        "expression, only reflects the control profile.\n\n" + table(["split", "representation", "pearson_r", "std", "n"], body)
    )


def _mae(results: DataFrame) -> str:
    s = pooling.mae_instability(results).first()
    if not s.n_folds:
        return "## Range of normalised mae\n\nNo mae rows."
    pairs = [list(r.values()) for r in _rows(pooling.mae_pairs(results).orderBy("fold"))]
    return (
        f"## Range of normalised mae\n\nTypical mae is {fmt(s.typical, 4)}, the median distance of ceiling and floor {fmt(s.median_denominator, 4)}: "
        f"a ratio of {fmt(s.ratio, 1)}, by which noise is amplified. The sign is wrong in {s.n_wrong_sign} of {s.n_folds} folds.\n\n"
        + table(["fold", "ceiling", "floor", "denominator"], [[p[0], *[fmt(v, 6) for v in p[1:]]] for p in pairs])
    )


def _versus(rows: list[dict]) -> str:
    head = ["metric", "per_drug_mean_delta", "ridge", "gap", "intervals overlap", "winner"]
    side = lambda r, t: f"{fmt(r[t + '_mean'])} ± {fmt(r[t + '_std'])}, n={r[t + '_n'] or 0}"
    body = [[r["metric"], side(r, "a"), side(r, "b"), r["gap"], r["overlap"], r["winner"]] for r in rows]
    wins = {r["winner"] for r in rows}
    verdict = (
        "ridge is better on at least one metric." if "ridge" in wins
        else "per_drug_mean_delta is better on at least one metric and ridge on none." if "per_drug_mean_delta" in wins
        else "No metric separates the two."
    )
    return "## Per-compound mean against ridge on held_out_context\n\n" + table(head, body) + f"\n\n{verdict}"


def _data(results: DataFrame, meta: dict, regimes) -> str:
    parts = ["## Fallbacks, dropped data and quality control"]
    for title, column in (("Fallback to the global mean", "fallback_rate"), ("Dose collapsed", "fallback_rate_dose_collapsed")):
        body = [[r["baseline"], *[r[s] for s in regimes]] for r in _rows(pooling.fallback_table(results, column).orderBy("baseline"))]
        parts.append(f"\n### {title}\n\n" + table(["baseline", *regimes], body))
    d = meta.get("dataset_meta", {})
    n, zero = d.get("n_conditions"), d.get("n_conditions_zero_de_genes")
    if n:
        parts.append(f"\n- {zero} of {n} conditions ({100 * zero / n:.1f}%) have no differential gene.")
    for key in ("qc", "mito_drop_rate", "plate_matching", "time_identity"):
        if key in d:
            parts.append(f"\n### {key}\n\n" + table(["counter", "value"], [[k, v] for k, v in d[key].items()]))
    if d:
        parts.append(
            f"\n- Genes: {d['n_genes_total']} of {d['n_genes_before']} detected in at least {d['min_detection_fraction']:.0%} of all cells."
            f"\n- Half profiles cover {d.get('halves_n_genes')} genes (union of all folds' train-only selections), {d.get('n_ceiling_reps')} repetitions."
            f"\n- Batch metadata available: {d['batch_metadata_available']} (column {d['detected_columns'].get('batch')})."
        )
    return "\n".join(parts)


def _answers(results: DataFrame, inflation: list[dict]) -> str:
    wins = _rows(pooling.beats_floor(results).orderBy("metric", "baseline"))
    best = {(r["metric"], r["split"]): r["best"] for r in _rows(pooling.best_by_split(results))}
    lines = ["## Four questions", "\n### 1. Does any baseline beat no_change?\n"]
    lines += [f"- {w['baseline']} on {w['metric']}: {fmt(w['mean'])} against {fmt(w['floor_mean'])}, normalised {fmt(w['normalized_mean'])} ± {fmt(w['normalized_std'])}" for w in wins]
    lines += [] if wins else ["No baseline does, with separated intervals."]
    lines.append("\n### 2. How much worse is held_out_context than random?\n")
    for m in METRIC_DIRECTION:
        r, h = best.get((m, "random")), best.get((m, "held_out_context"))
        lines.append(f"- {m}: best {fmt(r)} on random, {fmt(h)} on held_out_context, drop {fmt(None if r is None or h is None else r - h)}")
    lines.append("\n### 3. Does ridge beat the per-compound mean?\n\nSee the table above.")
    absolute = [r["mean"] for r in inflation if r["representation"] == "absolute" and r["mean"] is not None]
    lines.append(f"\n### 4. How much does absolute scoring inflate?\n\nno_change scores pearson_r up to {fmt(max(absolute, default=None))} on absolute expression and is undefined on deltas.")
    return "\n".join(lines)


def build_report(results: DataFrame, meta: dict) -> str:
    config = meta.get("config", {})
    pooled = _rows(pooling.pooled_results(results))
    present = {r["baseline"] for r in pooled} - {CEILING}
    names = [b for b in BASELINES if b in present] + sorted(present - set(BASELINES))
    regimes = [s for s in REGIMES if any(r["split"] == s for r in pooled)]
    inflation = _rows(pooling.inflation(results))
    head = (
        f"# Perturbation-response benchmark\n\nDataset `{config.get('dataset')}`, seed {config.get('seed')}, gene set {config.get('gene_set')} "
        f"({config.get('n_hvg')}), limits {meta.get('limits') or 'none'}, resume {meta.get('resume')}. {meta.get('n_folds')} folds, "
        f"{meta.get('n_leakage_checks')} checked for leakage before anything was fitted."
    )
    sections = [
        head, _floors(), _guard(results), _main(pooled, names, regimes, pooling.de_skip(results).first()), _secondary(pooled, names, regimes),
        _context(results, names), _inflation(inflation), _mae(results),
        _versus(_rows(pooling.compare_baselines(results, "per_drug_mean_delta", "ridge").orderBy("metric"))),
        _data(results, meta, list(REGIMES)), _answers(results, inflation),
    ]
    return "\n\n---\n\n".join(sections) + "\n"

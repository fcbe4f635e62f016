"""DuckDB SQL for every registered query that SQL can express."""

from __future__ import annotations

from oracle import base, sweep
from oracle.base import KEYS, query, r6

ORACLE: dict[str, str] = {}


def _prepared(min_cells: int = 10, **variant):
    return base.cells(**variant) + base.matching(min_cells) + base.profiles()


_STD = _prepared()
_FALLBACK = dict(fallback_line="BUILDING", drop_controls_of_batch="1997")

ORACLE["cell_qc"] = query(_STD, f"""SELECT cell_id, n_genes, total_count, mito_count, {r6('pct_mito', 'pct_mito')},
    pass_min_genes, pass_mito, keep FROM stats""")

ORACLE["qc_summary"] = query(_STD, f"""SELECT count(*) AS n_cells_before_qc, count(*) FILTER (NOT pass_min_genes) AS n_cells_dropped_min_genes,
    count(*) FILTER (pass_min_genes AND NOT pass_mito) AS n_cells_dropped_mito, count(*) FILTER (keep) AS n_cells_after_qc,
    {r6('count(*) FILTER (pass_min_genes AND NOT pass_mito) / CAST(greatest(1, count(*) FILTER (pass_min_genes)) AS DOUBLE)', 'frac_cells_dropped_by_mito_overall')},
    true AS mito_filter_applied, """ + ", ".join(
    r6(f"quantile_cont(pct_mito, {p})", n) for n, p in
    [("mito_p25", .25), ("mito_median", .5), ("mito_p75", .75), ("mito_p90", .9), ("mito_p99", .99)]
) + ", CAST(50.0 AS DOUBLE) AS max_pct_mito_threshold FROM stats")

ORACLE["mito_drop_rates"] = query(_STD, f"""SELECT axis, bucket, count(*) FILTER (pass_min_genes) AS n_cells,
    {r6('count(*) FILTER (pass_min_genes AND NOT pass_mito) / CAST(nullif(count(*) FILTER (pass_min_genes), 0) AS DOUBLE)', 'drop_rate')}
    FROM (SELECT 'cell_line' AS axis, cell_line AS bucket, * FROM stats UNION ALL
          SELECT 'dose', CASE WHEN is_control THEN 'vehicle' ELSE CAST(dose AS VARCHAR) END, * FROM stats) GROUP BY axis, bucket""")

ORACLE["gene_detection"] = query(_STD, "SELECT gene_id, gene, n_detected, threshold, keep FROM detection")

_WHOLE = "coalesce(max(abs(cnt - round(cnt))) FILTER (cnt > 0) <= 1e-6, false)"
ORACLE["input_kind"] = query(_STD, f"""SELECT coalesce(max(cnt), 0) AS max_value, {_WHOLE} AS looks_integer,
    CASE WHEN {_WHOLE} AND max(cnt) > 30 THEN 'raw_counts' ELSE 'already_normalized_or_log' END AS detected_input FROM counts""")

ORACLE["control_flags"] = query(_STD, """SELECT compound, lower(compound) IN ('vehicle', 'control', 'dmso', 'none', 'untreated', 'ctrl') AS is_control,
    count(*) AS n_cells FROM obs0 GROUP BY ALL""")

ORACLE["lognorm_expression"] = query(_STD, f"SELECT cell_id, gene, {r6('value', 'value')} FROM expr JOIN genes USING (gene_idx)")

ORACLE["control_profiles"] = query(_STD, f"""SELECT cell_line, eff_batch AS batch, gene, {r6('control', 'control')}
    FROM cprof JOIN genes USING (gene_idx) WHERE eff_batch <> '{base.FALLBACK}'""")

ORACLE["control_profiles_cell_line"] = query(_STD, f"""SELECT cell_line, gene, {r6('control', 'control')}
    FROM cprof JOIN genes USING (gene_idx) WHERE eff_batch = '{base.FALLBACK}'""")

ORACLE["pseudobulk_x"] = query(_STD, f"SELECT cond_id, gene, {r6('x', 'x')} FROM prof")

_DELTA = f"SELECT {KEYS}, gene, {r6('x', 'x')}, {r6('control', 'control')}, {r6('delta', 'delta')} FROM prof"
ORACLE["pseudobulk_delta"] = query(_STD, _DELTA)
ORACLE["no_batch_delta"] = query(_prepared(with_batch=False), _DELTA)
ORACLE["control_fallback_delta"] = query(_prepared(**_FALLBACK), _DELTA)
ORACLE["time_identity"] = query(_prepared(half_year_time=True), _DELTA)

ORACLE["condition_obs"] = query(_prepared(200), f"SELECT cond_id, {KEYS}, {r6('log_dose', 'log_dose')}, batch, n_cells, target FROM conds")


def _plates(min_cells, **variant):
    return query(_prepared(min_cells, **variant) + [
        ("pc", f"""SELECT cond_id, bool_or(any_match) AS any_match, bool_or(eff_batch IS NOT NULL) AS any_control, max(n_total) AS n_total,
            CASE WHEN bool_or(any_match) THEN count(*) FILTER (usable) ELSE 1 END AS plates,
            CASE WHEN bool_or(any_match) THEN max(n_cells) FILTER (usable) / CAST(max(n_total) AS DOUBLE) ELSE 1 END AS purity,
            coalesce(sum(n_cells) FILTER (own IS NULL), 0) AS cu, count(*) FILTER (own IS NULL) AS pu FROM tg GROUP BY 1"""),
        ("pk", f"SELECT *, any_control AND n_total >= {min_cells} AS kept FROM pc"),
    ], f"""SELECT count(*) FILTER (kept) AS n_conditions_total, count(*) FILTER (kept AND plates > 1) AS n_conditions_multi_plate,
        {r6('avg(purity) FILTER (kept)', 'modal_plate_purity_mean')}, {r6('quantile_cont(purity, 0.5) FILTER (kept)', 'modal_plate_purity_median')},
        CAST(sum(cu) AS BIGINT) AS n_cells_dropped_plate_no_control, CAST(sum(pu) AS BIGINT) AS n_condition_plate_pairs_dropped_no_control,
        count(*) FILTER (NOT any_match AND any_control) AS n_conditions_fallback_control,
        count(*) FILTER (NOT any_control) AS n_conditions_line_without_control,
        count(*) FILTER (NOT kept) AS n_conditions_dropped_too_few_cells FROM pk""")


ORACLE["plate_matching"] = _plates(10)
ORACLE["plate_matching_dropped"] = _plates(150, **_FALLBACK)

_MWU = f"SELECT cond_id, eff_batch, gene, CAST(n_treated AS BIGINT) AS n_treated, CAST(n_control AS BIGINT) AS n_control, u, {r6('z', 'z')} FROM mw JOIN genes USING (gene_idx)"
ORACLE["mwu_plate_z"] = query(_STD + base.mwu(), _MWU)
ORACLE["mwu_fallback_z"] = query(_prepared(**_FALLBACK) + base.mwu(), _MWU)
ORACLE["stouffer_z"] = query(_STD + base.mwu(), f"SELECT cond_id, gene, {r6('z', 'z')} FROM stouffer JOIN genes USING (gene_idx)")
ORACLE["de_mask"] = query(_STD + base.mwu() + base.bh(), f"SELECT cond_id, gene, {r6('z', 'z')} FROM de JOIN genes USING (gene_idx)")
ORACLE["de_counts"] = query(_STD + base.mwu() + base.bh(), """SELECT cond_id, CAST(count(gene_idx) AS INTEGER) AS n_de
    FROM conds LEFT JOIN de USING (cond_id) GROUP BY 1""")

ORACLE["half_assignment"] = query(_STD + base.halves(), "SELECT cell_id, CAST(rep AS INTEGER) AS rep, half FROM split")
ORACLE["split_halves"] = query(_STD + base.halves(), f"""SELECT cond_id, CAST(rep AS INTEGER) AS rep, gene,
    {r6('max(h) FILTER (half = 0)', 'h0')}, {r6('max(h) FILTER (half = 1)', 'h1')} FROM half JOIN genes USING (gene_idx) GROUP BY ALL""")

# --- folds, selection, predictors ----------------------------------------------------------------

_FOLDS = _STD + sweep.folds()
for _regime in ("random", "held_out_context", "held_out_drug", "held_out_both"):
    ORACLE[f"folds_{_regime}"] = query(_FOLDS, f"SELECT regime, fold, cond_id, role FROM folds WHERE regime = '{_regime}'")

ORACLE["compound_groups"] = query(_FOLDS, """SELECT compound, "group", available, bucket, n_buckets FROM buckets""")

ORACLE["fold_meta"] = query(_FOLDS, """SELECT regime, fold,
    CASE WHEN regime IN ('held_out_context', 'held_out_both') THEN string_agg(DISTINCT cell_line, ',' ORDER BY cell_line) ELSE '' END AS held_out_cell_lines,
    CASE WHEN regime IN ('held_out_drug', 'held_out_both') THEN string_agg(DISTINCT compound, ',' ORDER BY compound) ELSE '' END AS held_out_compounds,
    CASE WHEN regime IN ('held_out_drug', 'held_out_both') THEN true END AS target_annotation_available
    FROM folds JOIN conds USING (cond_id) WHERE role = 'test' GROUP BY regime, fold""")

# sound folds first, then folds whose random test rows are copied into the context folds' training rows
_LEAK = _FOLDS + [
    ("lk", """SELECT regime, fold, cond_id, role FROM folds WHERE regime = 'held_out_context' UNION ALL
        SELECT 'held_out_context', fold, cond_id, 'train' FROM folds WHERE regime = 'held_out_context' AND role = 'test'
        AND cond_id IN (SELECT cond_id FROM folds WHERE regime = 'random' AND role = 'test')"""),
    ("lr", "SELECT lk.*, cell_line, compound FROM lk JOIN conds USING (cond_id)"),
    ("ll", "SELECT regime, fold, cell_line AS item, bool_or(role = 'train') AS tr, bool_or(role = 'test') AS te FROM lr GROUP BY ALL"),
]
ORACLE["leakage_violations"] = query(_FOLDS, """SELECT regime, fold, 'overlap' AS "check", cond_id AS item FROM folds
    GROUP BY regime, fold, cond_id HAVING bool_or(role = 'train') AND bool_or(role = 'test')
    UNION ALL SELECT regime, fold, 'line', cell_line FROM folds JOIN conds USING (cond_id) WHERE regime IN ('held_out_context', 'held_out_both')
    GROUP BY regime, fold, cell_line HAVING bool_or(role = 'train') AND bool_or(role = 'test')
    UNION ALL SELECT regime, fold, 'compound', compound FROM folds JOIN conds USING (cond_id) WHERE regime IN ('held_out_drug', 'held_out_both')
    GROUP BY regime, fold, compound HAVING bool_or(role = 'train') AND bool_or(role = 'test')""")
ORACLE["leakage_violations_planted"] = query(_LEAK, """SELECT regime, fold, 'overlap' AS "check", cond_id AS item FROM lk
    GROUP BY regime, fold, cond_id HAVING bool_or(role = 'train') AND bool_or(role = 'test')
    UNION ALL SELECT regime, fold, 'line_in_both_roles', item FROM ll WHERE tr AND te
    UNION ALL SELECT regime, fold, 'declared_line_in_train', item FROM ll WHERE tr AND fold = 'held_out_context/' || item""")

# every rule broken once, by held-out line; what is declared follows from the sound folds' test rows
_RULES = _FOLDS + [
    ("sound", "SELECT fold, split_part(split_part(fold, '/', 2), '__fold', 1) AS held, cond_id, role FROM folds WHERE regime = 'held_out_both'"),
    ("pl", """SELECT fold, cond_id, role FROM sound UNION ALL SELECT fold, cond_id, role FROM sound WHERE role = 'test' AND held = 'AUTOMOBILE'
        UNION ALL SELECT fold, cond_id, 'train' FROM sound WHERE role = 'test' AND held = 'BUILDING'
        UNION ALL SELECT fold, 'lost|' || cond_id, 'train' FROM sound WHERE role = 'test' AND held = 'FURNITURE'"""),
    ("said", """SELECT DISTINCT fold, CASE held WHEN 'MACHINERY' THEN 'elsewhere' ELSE cell_line END AS line, compound
        FROM sound JOIN conds USING (cond_id) WHERE role = 'test' AND held <> 'HOUSEHOLD'"""),
    ("pr", "SELECT pl.*, cell_line, compound FROM pl JOIN conds USING (cond_id)"),
    ("pls", "SELECT fold, cell_line AS item, bool_or(role = 'train') AS tr, bool_or(role = 'test') AS te FROM pr GROUP BY ALL"),
    ("pcs", "SELECT fold, compound AS item, bool_or(role = 'train') AS tr, bool_or(role = 'test') AS te FROM pr GROUP BY ALL"),
    ("broken", """SELECT fold, 'duplicate' AS "check", cond_id AS item FROM pl GROUP BY fold, cond_id, role HAVING count(*) > 1
        UNION ALL SELECT fold, 'overlap', cond_id FROM pl GROUP BY fold, cond_id HAVING bool_or(role = 'train') AND bool_or(role = 'test')
        UNION ALL SELECT fold, 'unknown_condition', cond_id FROM pl WHERE cond_id NOT IN (SELECT cond_id FROM conds)
        UNION ALL SELECT fold, 'line_in_both_roles', item FROM pls WHERE tr AND te
        UNION ALL SELECT fold, 'compound_in_both_roles', item FROM pcs WHERE tr AND te
        UNION ALL SELECT fold, 'test_line_not_declared', item FROM pls WHERE te AND (fold, item) NOT IN (SELECT (fold, line) FROM said)
        UNION ALL SELECT fold, 'declared_line_not_in_test', line FROM said WHERE (fold, line) NOT IN (SELECT (fold, item) FROM pls WHERE te)
        UNION ALL SELECT fold, 'test_compound_not_declared', item FROM pcs WHERE te AND (fold, item) NOT IN (SELECT (fold, compound) FROM said)
        UNION ALL SELECT fold, 'declared_line_in_train', item FROM pls WHERE tr AND (fold, item) IN (SELECT (fold, line) FROM said)
        UNION ALL SELECT fold, 'declared_compound_in_train', item FROM pcs WHERE tr AND (fold, item) IN (SELECT (fold, compound) FROM said)
        UNION ALL SELECT fold, 'test_line_outside_declared', item FROM pls WHERE te AND fold IN (SELECT fold FROM said)
            AND (fold, item) NOT IN (SELECT (fold, line) FROM said)"""),
]
ORACLE["leakage_every_rule"] = query(_RULES, """SELECT DISTINCT 'held_out_both' AS regime, fold, "check", item FROM broken""")

_SEL = _FOLDS + sweep.selection()
ORACLE["hvg_selection"] = query(_SEL, f"SELECT fold, gene, {r6('var', 'var')} FROM sel JOIN fvar USING (fold, gene_idx) JOIN genes USING (gene_idx)")
ORACLE["hvg_union"] = query(_SEL, "SELECT DISTINCT gene FROM sel JOIN genes USING (gene_idx)")
ORACLE["hvg_coverage"] = query(_SEL, """SELECT fold, gene FROM sel JOIN genes USING (gene_idx)
    WHERE gene_idx NOT IN (SELECT gene_idx FROM sel WHERE fold = 'random/holdout')""")

_PRED = _SEL + sweep.predictions()
for _name in ("no_change", "global_mean_delta", "per_drug_mean_delta", "nearest_context"):
    ORACLE[f"pred_{_name}"] = query(_PRED, f"""SELECT fold, cond_id, gene, {r6('pred', 'pred')}, fallback, tier
        FROM preds JOIN genes USING (gene_idx) WHERE baseline = '{_name}'""")
_SLOPE = "sum(log_dose * delta) / nullif(sum(log_dose * log_dose), 0) AS slope FROM train JOIN prof USING (cond_id) JOIN sel USING (fold, gene_idx)"
ORACLE["pred_dose_slope"] = query(_SEL + [
    ("own", f"SELECT fold, compound, gene_idx, {_SLOPE} GROUP BY fold, compound, gene_idx"),
    ("every", f"SELECT fold, gene_idx, {_SLOPE} GROUP BY fold, gene_idx"),
], f"""SELECT fold, f.cond_id, gene, {r6('log_dose * coalesce(own.slope, every.slope, 0)', 'pred')}, own.slope IS NULL AS fallback
    FROM folds f JOIN conds USING (cond_id) JOIN every USING (fold) JOIN genes USING (gene_idx) LEFT JOIN own USING (fold, compound, gene_idx) WHERE role = 'test'""")
for _name, _regimes in (("ridge", "'random', 'held_out_context'"), ("ridge_no_drug", "'held_out_drug', 'held_out_both'")):
    ORACLE[f"{_name}_predictions"] = query(_PRED, f"""SELECT fold, cond_id, gene, {r6('pred', 'pred')}, fallback, alpha, n_components
        FROM ridge JOIN genes USING (gene_idx) WHERE regime IN ({_regimes})""")
ORACLE["nearest_line"] = query(_PRED, f"SELECT fold, cond_id, line, tier, {r6('sim', 'sim')} FROM cands JOIN sims USING (fold, cond_id, line)")
ORACLE["fallback_rates"] = query(_PRED, f"""SELECT fold, baseline, {r6('fallback_rate', 'fallback_rate')},
    {r6('fallback_rate_dose_collapsed', 'fallback_rate_dose_collapsed')} FROM rates""")

# --- scores and results --------------------------------------------------------------------------

_SCORES = _PRED + base.mwu() + base.bh() + base.halves() + sweep.scores()
_PAIR = "fold, baseline, target, rep, cond_id"
for _rep in ("delta", "absolute"):
    ORACLE[f"condition_scores_{_rep}"] = query(_SCORES, f"""SELECT {_PAIR}, {r6('pearson_r', 'pearson_r')}, {r6('mae', 'mae')},
        {r6('pearson_r_de', 'pearson_r_de')}, {r6('direction_acc_de', 'direction_acc_de')} FROM cmx
        WHERE representation = '{_rep}' AND baseline <> 'ceiling'""")
ORACLE["pert_discrimination"] = query(_SCORES, f"""SELECT {_PAIR}, representation, {r6('pert_discrimination', 'pert_discrimination')}
    FROM pd WHERE baseline <> 'ceiling'""")
ORACLE["ceiling_scores"] = query(_SCORES, f"SELECT {_PAIR}, representation, " + ", ".join(r6(m, m) for m in sweep.METRICS) + " FROM sc WHERE baseline = 'ceiling'")
ORACLE["metric_aggregate"] = query(_SCORES, f"""SELECT fold, baseline, target, representation, metric, {r6('value', 'mean')}, {r6('std', 'std')}, n, n_skipped FROM agg""")

_RES = _SCORES + sweep.results()
_RKEYS = "split, fold, baseline, metric, representation, target"
ORACLE["normalized_scores"] = query(_RES, f"""SELECT {_RKEYS}, {r6('value', 'value')}, floor_source, {r6('floor_value', 'floor_value')},
    {r6('ceiling_value', 'ceiling_value')}, {r6('normalized', 'normalized')}, {r6('normalized_std', 'normalized_std')}, normalization_valid, n_conditions, n_test FROM res""")
_COMBO = "split || '~' || fold || '~' || metric || '~' || representation || '~' || target"
ORACLE["direction_guard"] = query(_RES, f"""SELECT count(DISTINCT {_COMBO}) AS n_total, count(DISTINCT {_COMBO}) FILTER (NOT normalization_valid) AS n_fired FROM res""")

_P5 = "split, baseline, metric, representation, target"
ORACLE["pooled_results"] = query(
    _RES + sweep.pooled(_P5, "res", "pr_raw") + sweep.pooled(_P5, "res", "pr_norm", "normalized", "normalized_std", "normalization_valid"),
    f"""SELECT {_P5}, k.n_guard_fired, {r6('r.mean', 'mean')}, {r6('r.std', 'std')}, r.n AS n, {r6('m.mean', 'normalized_mean')},
    {r6('m.std', 'normalized_std')}, m.n AS normalized_n FROM (SELECT {_P5}, count(*) FILTER (NOT normalization_valid) AS n_guard_fired FROM res GROUP BY ALL) k
    LEFT JOIN pr_raw r USING ({_P5}) LEFT JOIN pr_norm m USING ({_P5})""")

_PRIMARY = "representation = 'delta' AND target = 'replicate_half'"
_HIGHER = "metric IN ('pearson_r', 'pearson_r_de', 'direction_acc_de')"
for _query, _other in (("b3_vs_b5_gap", "nearest_context"), ("b3_vs_b4_gap", "ridge")):
    ORACLE[_query] = query(
        _RES + sweep.pooled("metric, baseline", "res", "pb", where=f"{_PRIMARY} AND split = 'held_out_context'") + [
            ("ci", "SELECT *, mean - 1.96 * std / sqrt(n) AS lo, mean + 1.96 * std / sqrt(n) AS hi FROM pb"),
            ("j", f"""SELECT a.metric, a.mean AS am, a.std AS asd, a.n AS an, b.mean AS bm, b.std AS bsd, b.n AS bn, a.hi < b.lo OR a.lo > b.hi AS apart
                FROM ci a JOIN ci b USING (metric) WHERE a.baseline = 'per_drug_mean_delta' AND b.baseline = '{_other}'"""),
        ], f"""SELECT metric, {r6('am', 'a_mean')}, {r6('asd', 'a_std')}, an AS a_n, {r6('bm', 'b_mean')}, {r6('bsd', 'b_std')}, bn AS b_n,
        {r6('bm - am', 'gap')}, NOT apart AS overlap, CASE WHEN NOT apart THEN 'no significant difference'
        WHEN (bm > am) = ({_HIGHER}) THEN '{_other}' ELSE 'per_drug_mean_delta' END AS winner FROM j""")

ORACLE["beats_no_change"] = query(
    _RES + [("prim", f"SELECT * FROM res WHERE {_PRIMARY} AND baseline <> 'ceiling'"),
            ("none", "SELECT n.* EXCLUDE (baseline), o.baseline FROM prim n JOIN prim o USING (fold, metric) WHERE n.baseline = 'no_change' AND o.baseline <> 'no_change'")]
    + sweep.pooled("metric, baseline", "none", "pn") + sweep.pooled("metric, baseline", "prim", "po", where="baseline <> 'no_change'")
    + sweep.pooled("metric, baseline", "prim", "pz", "normalized", "normalized_std", "normalization_valid"),
    f"""SELECT metric, baseline, {r6('b.mean', 'mean')}, {r6('a.mean', 'floor_mean')}, {r6('z.mean', 'normalized_mean')}, {r6('z.std', 'normalized_std')}
    FROM po b JOIN pn a USING (metric, baseline) LEFT JOIN pz z USING (metric, baseline)
    WHERE CASE WHEN {_HIGHER} THEN b.mean > a.mean ELSE b.mean < a.mean END
    AND (b.mean + 1.96 * b.std / sqrt(b.n) < a.mean - 1.96 * a.std / sqrt(a.n) OR b.mean - 1.96 * b.std / sqrt(b.n) > a.mean + 1.96 * a.std / sqrt(a.n))""")

ORACLE["best_by_split"] = query(
    _RES + sweep.pooled("metric, split, baseline", "res", "pb", "normalized", "normalized_std", f"normalization_valid AND baseline <> 'ceiling' AND {_PRIMARY}"),
    f"SELECT metric, split, {r6('max(mean)', 'best')} FROM pb GROUP BY ALL")

ORACLE["fallback_table"] = query(_RES, "SELECT baseline, " + ", ".join(
    r6(f"avg(fallback_rate) FILTER (split = '{s}')", s) for s in ("random", "held_out_context", "held_out_drug", "held_out_both")
) + " FROM (SELECT DISTINCT split, fold, baseline, fallback_rate FROM res WHERE baseline <> 'ceiling') GROUP BY 1")

ORACLE["de_skip_fraction"] = query(_RES, f"""SELECT CAST(sum(n_skipped) AS BIGINT) AS n_skipped, CAST(sum(n_test) AS BIGINT) AS n_test,
    {r6('sum(n_skipped) / CAST(sum(n_test) AS DOUBLE)', 'skip_fraction')} FROM res
    WHERE baseline = 'global_mean_delta' AND metric = 'pearson_r_de' AND representation = 'delta' AND target = 'full_pseudobulk'""")

ORACLE["mae_instability"] = query(_RES + [
    ("mp", f"""SELECT fold, c.value AS ceiling, f.value AS floor, c.value - f.value AS d FROM res c JOIN res f USING (fold, metric, representation, target)
        WHERE metric = 'mae' AND c.baseline = 'ceiling' AND f.baseline = 'no_change' AND {_PRIMARY}"""),
    ("ty", "SELECT quantile_cont(v, 0.5) AS typical FROM (SELECT abs(ceiling) AS v FROM mp UNION ALL SELECT abs(floor) FROM mp)"),
], f"""SELECT {r6('quantile_cont(abs(d), 0.5)', 'median_denominator')}, count(*) FILTER (d > 0) AS n_wrong_sign, count(*) AS n_folds,
    {r6('any_value(typical)', 'typical')}, {r6('any_value(typical) / quantile_cont(abs(d), 0.5)', 'ratio')} FROM mp, ty""")

_INF = "baseline = 'no_change' AND metric = 'pearson_r' AND target = 'replicate_half'"
ORACLE["inflation_diagnostic"] = query(_RES + sweep.pooled("split, representation", "res", "pi", where=_INF),
    f"""SELECT split, representation, {r6('mean', 'mean')}, {r6('std', 'std')}, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT split, representation FROM res WHERE {_INF}) LEFT JOIN pi USING (split, representation)""")

# --- ready-made profiles (embeddings) --------------------------------------------------------------

ORACLE["embedding_nearest"] = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1)
    SELECT vec_id, e.label, round(list_cosine_similarity(v, c), 6) + 0.0 AS sim, c.label AS nearest FROM e CROSS JOIN c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, c.label) = 1"""

ORACLE["embedding_discrimination"] = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1),
    q AS (SELECT vec_id, label, v, c FROM e JOIN c USING (label))
    SELECT q.vec_id, round((count(*) FILTER (list_distance(c, o.v) < list_distance(c, q.v))
        + (count(*) FILTER (list_distance(c, o.v) = list_distance(c, q.v)) - 1) / 2.0) / (count(*) - 1), 6) + 0.0 AS pert_discrimination
    FROM q CROSS JOIN e o GROUP BY q.vec_id"""

#: Arrangements of up to 8 and any number of others by U: one pooled place after the other goes to either side.
ORACLE["embedding_rank_tests"] = """WITH RECURSIVE e AS (SELECT label, floor(vec_id / 64) AS b, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    long AS (SELECT label, b, i - 1 AS component, v[i] + 1 AS x FROM e, range(1, (SELECT max(len(v)) + 1 FROM e)) r(i)),
    n AS (SELECT label, b, count(*) AS n FROM e GROUP BY ALL),
    pairs AS (SELECT t.label, t.b, t.n AS n1, c.n AS n2 FROM n t JOIN n c ON c.label = 0 AND c.b = t.b WHERE t.label <> 0 AND t.n >= 2 AND c.n >= 2),
    blocks AS (SELECT p.label, b, component, x, n1, n2, count(*) FILTER (l.label <> 0) AS t, count(*) FILTER (l.label = 0) AS c
        FROM pairs p JOIN long l USING (b) WHERE l.label IN (0, p.label) GROUP BY ALL),
    ranked AS (SELECT *, coalesce(sum(t + c) OVER (PARTITION BY label, b, component ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + c + 1) / 2.0 AS rank FROM blocks),
    sums AS (SELECT label, b, component, n1, n2, CAST(sum(t * rank) - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS u, CAST(sum(CAST(t + c AS DOUBLE) ** 3 - (t + c)) AS DOUBLE) AS ties,
        sum(t * x) / n1 AS mt, sum(c * x) / n2 AS mc FROM ranked GROUP BY label, b, component, n1, n2),
    flagged AS (SELECT *, least(n1, n2) <= 8 AND max(ties) OVER (PARTITION BY label, b) = 0 AS exact, n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))) AS v FROM sums),
    places AS (SELECT max(n1 + n2) AS n FROM flagged WHERE exact),
    ways(i, s, u, w) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
        SELECT i + 1, s + side, u + CASE side WHEN 1 THEN i - s ELSE 0 END, sum(w) FROM ways, (VALUES (0), (1)) d(side), places WHERE i < n AND s + side <= 8 GROUP BY 1, 2, 3),
    tails AS (SELECT s AS small, i - s AS large, u, sum(w) OVER (PARTITION BY i, s ORDER BY u) / sum(w) OVER (PARTITION BY i, s) AS p FROM ways)
    SELECT 'all|label ' || f.label || '|1.0|24.0' AS cond_id, CAST(CAST(b AS BIGINT) AS VARCHAR) AS eff_batch, CAST(component AS INTEGER) AS component,
        CAST(n1 AS BIGINT) AS n_treated, CAST(n2 AS BIGINT) AS n_control, f.u,
        round(CASE WHEN exact THEN NULL WHEN v > 0 THEN greatest((abs(f.u - n1 * n2 / 2.0) - 0.5) / sqrt(v), 0) * CASE WHEN mt < mc THEN -1 ELSE 1 END ELSE 0 END, 6) + 0.0 AS z,
        CASE WHEN exact THEN round(least(2 * p, 1), 12) END AS p
    FROM flagged f LEFT JOIN tails t ON exact AND small = least(n1, n2) AND large = greatest(n1, n2) AND t.u = least(f.u, n1 * n2 - f.u)"""

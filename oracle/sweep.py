"""SQL blocks for folds, predictors, scores and results."""

from __future__ import annotations

from oracle.base import KEYS

METRICS = {
    "pearson_r": True, "mae": False, "pearson_r_de": True, "direction_acc_de": True, "pert_discrimination": False,
}  # True: higher is better
FLOORS = {
    "pearson_r": "global_mean_delta", "pearson_r_de": "global_mean_delta", "mae": "no_change",
    "direction_acc_de": "global_mean_delta", "pert_discrimination": "no_change",
}


def groups(seed: int = 0):
    return [
        ("known", """SELECT compound, min(CASE WHEN lower(target) NOT IN ('', 'nan', 'unknown') THEN target END) AS t FROM conds GROUP BY 1"""),
        ("cgroups", """SELECT compound, CASE WHEN NOT (SELECT bool_or(t IS NOT NULL) FROM known) THEN compound
            ELSE coalesce(t, '__unknown__' || compound) END AS "group", (SELECT bool_or(t IS NOT NULL) FROM known) AS available FROM known"""),
        ("gorder", f"""SELECT "group", row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', 'drug', "group"))) AS rk, count(*) OVER () AS n
            FROM (SELECT DISTINCT "group" FROM cgroups)"""),
        ("buckets", """SELECT compound, "group", available, CAST((rk - 1) % least(5, n) AS INTEGER) AS bucket, CAST(least(5, n) AS INTEGER) AS n_buckets
            FROM cgroups JOIN gorder USING ("group")"""),
        ("lines", "SELECT DISTINCT cell_line AS line FROM conds"),
    ]


def folds(seed: int = 0):
    return groups(seed) + [
        ("f_random", f"""SELECT 'random' AS regime, 'random/holdout' AS fold, cond_id,
            CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', 'random', cond_id)))
            <= greatest(1, round_even(CAST(0.2 AS DOUBLE) * count(*) OVER (), 0)) THEN 'test' ELSE 'train' END AS role FROM conds"""),
        ("f_context", """SELECT 'held_out_context' AS regime, 'held_out_context/' || line AS fold, cond_id,
            CASE WHEN cell_line = line THEN 'test' ELSE 'train' END AS role FROM conds CROSS JOIN lines"""),
        ("f_drug0", """SELECT 'held_out_drug' AS regime, 'held_out_drug/fold' || b AS fold, cond_id,
            CASE WHEN bucket = b THEN 'test' ELSE 'train' END AS role FROM conds JOIN buckets USING (compound), range(5) r(b) WHERE b < n_buckets"""),
        ("f_both0", """SELECT 'held_out_both' AS regime, 'held_out_both/' || line || '__fold' || b AS fold, cond_id,
            CASE WHEN cell_line = line AND bucket = b THEN 'test' WHEN cell_line <> line AND bucket <> b THEN 'train' END AS role
            FROM conds JOIN buckets USING (compound) CROSS JOIN lines, range(5) r(b) WHERE b < n_buckets"""),
        ("folds", """SELECT * FROM f_random UNION ALL SELECT * FROM f_context UNION ALL
            SELECT * FROM (SELECT * FROM f_drug0 UNION ALL SELECT * FROM f_both0 WHERE role IS NOT NULL) WHERE fold IN
            (SELECT fold FROM (SELECT * FROM f_drug0 UNION ALL SELECT * FROM f_both0) GROUP BY 1 HAVING count(*) FILTER (role = 'test') > 0
             AND count(*) FILTER (role = 'train') > 0)"""),
    ]


def selection(n_hvg: int = 15):
    return [
        ("train", "SELECT fold, cond_id FROM folds WHERE role = 'train'"),
        ("fvar", "SELECT fold, gene_idx, var_pop(x) AS var FROM train JOIN prof USING (cond_id) GROUP BY ALL"),
        ("sel", f"""SELECT fold, gene_idx FROM fvar QUALIFY row_number() OVER (PARTITION BY fold ORDER BY var DESC, gene_idx DESC) <= {n_hvg}"""),
    ]


def ridge():
    """Ridge in the space of the genes themselves, as one dense system per fold, held part and alpha.

    With no component left out, whitening turns into a penalty: alpha times the control covariance on the genes'
    coefficients, alpha on the dose and on each compound, none on the constant.
    """
    own_compounds = "regime IN ('random', 'held_out_context')"
    return [
        ("rtrain", """SELECT fold, cond_id, count(*) OVER w AS n, avg(log_dose) OVER w AS dose_mean, stddev_pop(log_dose) OVER w AS dose_sd,
            CAST((row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', '0', 'ridge-cv', fold, cond_id))) - 1) % least(5, count(*) OVER w) AS INTEGER) AS cv
            FROM train JOIN conds USING (cond_id) WINDOW w AS (PARTITION BY fold)"""),
        ("rfold", f"""SELECT fold, {own_compounds} AS drugs, any_value(n) AS n, any_value(dose_mean) AS dose_mean,
            CASE WHEN any_value(dose_sd) > 1e-12 THEN any_value(dose_sd) ELSE 1.0 END AS dose_sd, list(DISTINCT compound ORDER BY compound) AS names
            FROM rtrain JOIN conds USING (cond_id) JOIN (SELECT DISTINCT regime, fold FROM folds) USING (fold) GROUP BY fold, regime"""),
        ("centre", "SELECT fold, gene_idx, avg(control) AS m FROM tp GROUP BY ALL"),
        ("rgenes", """SELECT fold, cond_id, list(control - m ORDER BY gene_idx) AS x, list(delta ORDER BY gene_idx) AS y, count(*) AS g
            FROM folds JOIN prof USING (cond_id) JOIN centre USING (fold, gene_idx) GROUP BY ALL"""),
        ("rrows", """SELECT fold, cond_id, cv, n, g, drugs AND NOT list_contains(names, compound) AS fallback, y,
            list_concat([1.0::DOUBLE], x, [(log_dose - dose_mean) / dose_sd],
                CASE WHEN drugs THEN list_transform(names, lambda c: CASE WHEN c = compound THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE []::DOUBLE[] END) AS x
            FROM rgenes JOIN conds USING (cond_id) JOIN rfold USING (fold) LEFT JOIN (SELECT fold, cond_id, cv FROM rtrain) USING (fold, cond_id)"""),
        ("rx", "SELECT fold, cond_id, cv, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS xi FROM rrows"),
        ("rv", "SELECT fold, cond_id, unnest(range(1, len(x) + len(y) + 1)) AS j, unnest(list_concat(x, y)) AS v FROM rrows WHERE cv IS NOT NULL"),
        ("rsums", "SELECT fold, cv, i, j, sum(xi * v) AS s FROM rx JOIN rv USING (fold, cond_id) GROUP BY ALL"),
        ("rwhole", "SELECT fold, i, j, sum(s) AS s FROM rsums GROUP BY ALL"),
        ("rdim", "SELECT fold, any_value(len(x)) AS p, any_value(g) AS g, any_value(n) AS n FROM rrows GROUP BY 1"),
        ("rheld", "SELECT DISTINCT fold, cv AS held FROM rtrain UNION ALL SELECT DISTINCT fold, -1 FROM rtrain"),
        ("rsystem", """SELECT fold, held, alpha, i, p, list(w.s - coalesce(h.s, 0) + CASE WHEN i BETWEEN 2 AND g + 1 AND j BETWEEN 2 AND g + 1 THEN alpha * w.s / (n - 1)
                WHEN i = j AND i > 1 THEN alpha ELSE 0 END ORDER BY j) AS vals
            FROM rheld JOIN rdim USING (fold) JOIN rwhole w USING (fold) LEFT JOIN (SELECT fold, cv AS held, i, j, s FROM rsums) h USING (fold, held, i, j),
                (VALUES (0.1), (1.0), (10.0), (100.0), (1000.0)) a(alpha) GROUP BY fold, held, alpha, i, p"""),
        ("eliminated", """SELECT 0 AS k, fold, held, alpha, i, p, vals FROM rsystem
            UNION ALL SELECT k + 1, fold, held, alpha, i, p, CASE WHEN i = k + 1 THEN list_transform(pivot_row, lambda x: x / pivot_row[k + 1])
                ELSE list_transform(list_zip(vals, pivot_row), lambda z: z[1] - vals[k + 1] / pivot_row[k + 1] * z[2]) END
            FROM (SELECT *, max(CASE WHEN i = k + 1 THEN vals END) OVER (PARTITION BY fold, held, alpha) AS pivot_row FROM eliminated WHERE k < p)"""),
        ("coefs", "SELECT fold, held, alpha, i, unnest(range(1, len(vals) - p + 1)) AS j, unnest(vals[p + 1:]) AS c FROM eliminated WHERE k = p"),
        ("rmiss", """SELECT fold, held, alpha, sum((f - y[j]) ** 2) / count(*) AS miss FROM (
            SELECT fold, cond_id, cv AS held, alpha, j, sum(xi * c) AS f FROM rx JOIN coefs USING (fold, i) WHERE cv = held GROUP BY ALL)
            JOIN rrows USING (fold, cond_id) GROUP BY ALL"""),
        ("ralpha", """SELECT fold, alpha FROM (SELECT fold, alpha, avg(miss) AS miss FROM rmiss GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY fold ORDER BY miss, alpha) = 1"""),
        ("rpred", """SELECT fold, cond_id, j, alpha, sum(xi * c) AS pred FROM rx JOIN coefs USING (fold, i) JOIN ralpha USING (fold, alpha)
            WHERE cv IS NULL AND held = -1 GROUP BY ALL"""),
        ("rgene", "SELECT fold, gene_idx, row_number() OVER (PARTITION BY fold ORDER BY gene_idx) AS j FROM sel"),
        ("ridge", f"""SELECT regime, fold, cond_id, CASE WHEN {own_compounds} THEN 'ridge' ELSE 'ridge_no_drug' END AS baseline, gene_idx, pred, fallback,
            CAST(alpha AS DOUBLE) AS alpha, CAST(least(50, n - 1, g) AS INTEGER) AS n_components
            FROM rpred JOIN rgene USING (fold, j) JOIN rrows USING (fold, cond_id) JOIN testx USING (fold, cond_id)"""),
    ]


def predictions():
    plain = [
        ("testx", f"SELECT regime, fold, cond_id, {KEYS} FROM folds JOIN conds USING (cond_id) WHERE role = 'test'"),
        ("tp", f"SELECT fold, cond_id, {KEYS}, gene_idx, delta, control FROM train JOIN prof USING (cond_id) JOIN sel USING (fold, gene_idx)"),
        ("gm", "SELECT fold, gene_idx, avg(delta) AS m FROM tp GROUP BY ALL"),
        ("cd", "SELECT fold, compound, dose, gene_idx, avg(delta) AS m FROM tp GROUP BY ALL"),
        ("cm1", "SELECT fold, compound, gene_idx, avg(delta) AS m FROM tp GROUP BY ALL"),
        ("lcd", "SELECT fold, cell_line AS line, compound, dose, gene_idx, avg(delta) AS m FROM tp GROUP BY ALL"),
        ("lcm", "SELECT fold, cell_line AS line, compound, gene_idx, avg(delta) AS m FROM tp GROUP BY ALL"),
        ("lctrl", "SELECT fold, cell_line AS line, gene_idx, avg(control) AS m FROM tp GROUP BY ALL"),
        ("sims", """SELECT x.fold, x.cond_id, line, sum(control * m) / (sqrt(sum(control * control)) * sqrt(sum(m * m))) AS sim
            FROM testx x JOIN prof p USING (cond_id) JOIN lctrl l ON l.fold = x.fold AND l.gene_idx = p.gene_idx GROUP BY ALL"""),
        ("holds", "SELECT DISTINCT fold, cell_line AS line, compound, dose AS held FROM tp"),
        ("cands", """SELECT fold, cond_id, line, min(CASE WHEN held = dose THEN 0 ELSE 1 END) AS tier
            FROM testx JOIN holds USING (fold, compound) GROUP BY ALL"""),
        ("pick", """SELECT * FROM cands JOIN sims USING (fold, cond_id, line)
            QUALIFY row_number() OVER (PARTITION BY fold, cond_id ORDER BY tier, sim DESC, line) = 1"""),
        ("slots", "SELECT * FROM testx JOIN sel USING (fold)"),
    ]
    return plain + ridge() + [
        ("preds", """SELECT fold, cond_id, 'no_change' AS baseline, gene_idx, CAST(0 AS DOUBLE) AS pred, false AS fallback, CAST(NULL AS INTEGER) AS tier FROM slots
            UNION ALL SELECT fold, cond_id, 'global_mean_delta', gene_idx, m, false, NULL FROM slots JOIN gm USING (fold, gene_idx)
            UNION ALL SELECT s.fold, s.cond_id, 'per_drug_mean_delta', s.gene_idx, coalesce(cd.m, cm1.m, gm.m), cd.m IS NULL AND cm1.m IS NULL,
                CASE WHEN cd.m IS NOT NULL THEN 0 WHEN cm1.m IS NOT NULL THEN 1 ELSE 2 END FROM slots s
                LEFT JOIN cd USING (fold, compound, dose, gene_idx) LEFT JOIN cm1 USING (fold, compound, gene_idx) LEFT JOIN gm USING (fold, gene_idx)
            UNION ALL SELECT s.fold, s.cond_id, 'nearest_context', s.gene_idx, CASE p.tier WHEN 0 THEN lcd.m WHEN 1 THEN lcm.m ELSE gm.m END,
                p.tier IS NULL, coalesce(p.tier, 2) FROM slots s LEFT JOIN pick p USING (fold, cond_id)
                LEFT JOIN lcd ON lcd.fold = s.fold AND lcd.line = p.line AND lcd.compound = s.compound AND lcd.dose = s.dose AND lcd.gene_idx = s.gene_idx
                LEFT JOIN lcm ON lcm.fold = s.fold AND lcm.line = p.line AND lcm.compound = s.compound AND lcm.gene_idx = s.gene_idx
                LEFT JOIN gm ON gm.fold = s.fold AND gm.gene_idx = s.gene_idx
            UNION ALL SELECT fold, cond_id, baseline, gene_idx, pred, fallback, NULL FROM ridge"""),
        ("rates", """SELECT fold, baseline, avg(CASE WHEN fallback THEN 1.0 ELSE 0 END) AS fallback_rate,
            avg(CASE WHEN tier IS NOT NULL THEN CASE WHEN tier = 1 THEN 1.0 ELSE 0 END END) AS fallback_rate_dose_collapsed
            FROM (SELECT DISTINCT fold, baseline, cond_id, fallback, tier FROM preds) GROUP BY ALL"""),
    ]


def scores():
    corr = lambda p, t, f="": (
        f"CASE WHEN count({p}) {f} >= 2 AND min({p}) {f} <> max({p}) {f} AND min({t}) {f} <> max({t}) {f} "
        f"THEN CASE WHEN count({p}) {f} = 2 THEN sign(covar_pop({p}, {t}) {f}) ELSE corr({p}, {t}) {f} END END"
    )
    de = "FILTER (de)"
    return [
        ("truth", """SELECT s.fold, s.cond_id, gene_idx, p.delta, p.control, d.gene_idx IS NOT NULL AS de
            FROM slots s JOIN prof p USING (cond_id, gene_idx) LEFT JOIN de d USING (cond_id, gene_idx)"""),
        ("h01", "SELECT cond_id, rep, gene_idx, max(h) FILTER (half = 0) AS h0, max(h) FILTER (half = 1) AS h1 FROM half GROUP BY ALL"),
        ("pr", """SELECT fold, baseline, 'full_pseudobulk' AS target, -1 AS rep, cond_id, gene_idx, pred AS p, delta AS t, control AS c, de
                FROM preds JOIN truth USING (fold, cond_id, gene_idx)
            UNION ALL SELECT fold, baseline, 'replicate_half', CAST(rep AS INTEGER), cond_id, gene_idx, pred, h1, control, de
                FROM preds JOIN truth USING (fold, cond_id, gene_idx) JOIN h01 USING (cond_id, gene_idx)
            UNION ALL SELECT fold, 'ceiling', 'replicate_half', CAST(rep AS INTEGER), cond_id, gene_idx, h0, h1, control, de
                FROM truth JOIN h01 USING (cond_id, gene_idx)"""),
        ("bothrep", """SELECT 'delta' AS representation, fold, baseline, target, rep, cond_id, gene_idx, p, t, de FROM pr
            UNION ALL SELECT 'absolute', fold, baseline, target, rep, cond_id, gene_idx, c + p, c + t, de FROM pr"""),
        ("cmx", f"""SELECT fold, baseline, target, rep, cond_id, representation, {corr('p', 't')} AS pearson_r, avg(abs(p - t)) AS mae,
            {corr('p', 't', de)} AS pearson_r_de,
            CASE WHEN count(*) {de} >= 2 THEN avg(CASE WHEN sign(p) = sign(t) THEN 1.0 ELSE 0 END) {de} END AS direction_acc_de
            FROM bothrep GROUP BY ALL"""),
        ("vecs", """SELECT fold, baseline, target, rep, cond_id, representation, list(p ORDER BY gene_idx) AS p, list(t ORDER BY gene_idx) AS t
            FROM bothrep GROUP BY ALL"""),
        ("pool", "SELECT DISTINCT fold, target, rep, representation, cond_id AS other, t AS ot FROM vecs"),
        ("pd", """SELECT v.fold, v.baseline, v.target, v.rep, v.cond_id, v.representation,
            (count(*) FILTER (list_distance(p, ot) < list_distance(p, t)) + (count(*) FILTER (list_distance(p, ot) = list_distance(p, t)) - 1) / 2.0)
            / nullif(count(*) - 1, 0) AS pert_discrimination
            FROM vecs v JOIN pool o USING (fold, target, rep, representation) GROUP BY ALL"""),
        ("sc", "SELECT * FROM cmx JOIN pd USING (fold, baseline, target, rep, cond_id, representation)"),
        ("vals", " UNION ALL ".join(
            f"SELECT fold, baseline, target, rep, cond_id, representation, '{m}' AS metric, {m} AS v FROM sc" for m in METRICS)),
        ("agg", """SELECT fold, baseline, target, representation, metric, avg(v) AS value,
            CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END AS std, count(v) AS n, count(*) - count(v) AS n_skipped FROM vals GROUP BY ALL"""),
    ]


def results():
    floor = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{b}'" for m, b in FLOORS.items()) + " END"
    higher = "metric IN (" + ", ".join(f"'{m}'" for m, up in METRICS.items() if up) + ")"
    return [
        ("agg2", "SELECT * FROM agg UNION ALL SELECT * REPLACE ('full_pseudobulk' AS target) FROM agg WHERE baseline = 'ceiling'"),
        ("flo", f"SELECT fold, target, representation, metric, value AS floor_value FROM agg WHERE baseline = {floor}"),
        ("cei", "SELECT fold, representation, metric, value AS ceiling_value FROM agg WHERE baseline = 'ceiling'"),
        ("ntest", "SELECT regime AS split, fold, count(*) AS n_test FROM folds WHERE role = 'test' GROUP BY ALL"),
        ("res0", f"""SELECT *, {floor} AS floor_source, coalesce(ceiling_value = floor_value OR (ceiling_value > floor_value) = ({higher}), true) AS normalization_valid
            FROM agg2 LEFT JOIN flo USING (fold, target, representation, metric) LEFT JOIN cei USING (fold, representation, metric)
            JOIN ntest USING (fold) LEFT JOIN rates USING (fold, baseline)"""),
        ("res", """SELECT *, n AS n_conditions,
            CASE WHEN normalization_valid AND ceiling_value <> floor_value THEN (value - floor_value) / (ceiling_value - floor_value) END AS normalized,
            CASE WHEN normalization_valid AND ceiling_value <> floor_value THEN std / abs(ceiling_value - floor_value) END AS normalized_std FROM res0"""),
    ]


def pooled(keys: str, source: str, name: str, value: str = "value", std: str = "std", where: str = "true"):
    """Fold-weighted pool as three expressions (mean, std, n) per key."""
    known = "n > 1 AND s IS NOT NULL"
    return [
        (f"{name}_u", f"SELECT {keys}, CAST(n_conditions AS DOUBLE) AS n, {value} AS v, {std} AS s FROM {source} WHERE {value} IS NOT NULL AND n_conditions > 0 AND {where}"),
        (f"{name}_t", f"""SELECT {keys}, sum(n) AS total, sum(n * v) / sum(n) AS mean,
            coalesce(sum(n * s) FILTER ({known}) / sum(n) FILTER ({known}), 0) AS imputed FROM {name}_u GROUP BY ALL"""),
        (name, f"""SELECT {keys}, mean, sqrt(greatest(sum(n * (CASE WHEN {known} THEN s ELSE imputed END ** 2 + (v - mean) ** 2)) / total, 0)) AS std,
            CAST(total AS BIGINT) AS n FROM {name}_u JOIN {name}_t USING ({keys}) GROUP BY {keys}, mean, total"""),
    ]

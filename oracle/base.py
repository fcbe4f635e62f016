"""SQL building blocks for checking the Spark queries in DuckDB.

Each function returns (name, body) pairs of common table expressions; `query` strings them together.
The SQL restates what is computed in the plainest form, with none of the engine's physical tricks.
"""

from __future__ import annotations

KEYS = "cell_line, compound, dose, time"
FALLBACK = "__cellline_fallback__"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def query(ctes: list[tuple[str, str]], final: str) -> str:
    again = "RECURSIVE " if any(f"FROM {n} WHERE" in b and "UNION ALL" in b for n, b in ctes) else ""
    return f"WITH {again}" + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + final


def cells(
    min_genes: int = 2, max_pct_mito: float = 50.0, half_year_time: bool = False, with_batch: bool = True,
    drop_controls_of_batch: str | None = None, fallback_line: str | None = None,
):
    ctrl = "o_orderpriority = '4-NOT SPECIFIED'"
    time = f"CASE WHEN {ctrl} OR month(o_orderdate) <= 6 THEN 24.0 ELSE 72.0 END" if half_year_time else "24.0"
    batch = "CAST(year(o_orderdate) AS VARCHAR)"
    if fallback_line:
        batch = f"CASE WHEN c_mktsegment = '{fallback_line}' AND o_orderpriority = '2-HIGH' THEN 'x' || {batch} ELSE {batch} END"
    if not with_batch:
        batch = "'__no_batch__'"
    where = ""
    if drop_controls_of_batch:
        where = f"WHERE NOT ({ctrl} AND CAST(year(o_orderdate) AS VARCHAR) = '{drop_controls_of_batch}')"
    return [
        ("planted", "SELECT * FROM (VALUES ('1-URGENT',3),('1-URGENT',7),('1-URGENT',11),('1-URGENT',15),"
                    "('3-MEDIUM',5),('3-MEDIUM',7),('3-MEDIUM',19)) t(compound, gene_id)"),
        ("obs0", f"""SELECT o_orderkey AS cell_id, c_mktsegment AS cell_line,
            CASE WHEN {ctrl} THEN 'control' ELSE o_orderpriority END AS compound,
            CAST(CASE WHEN {ctrl} THEN 0 WHEN o_orderstatus = 'F' THEN 10 WHEN o_orderstatus = 'O' THEN 100 ELSE 1000 END AS DOUBLE) AS dose,
            CAST({time} AS DOUBLE) AS time, {batch} AS batch,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'TARGET1' WHEN '2-HIGH' THEN 'TARGET1' WHEN '3-MEDIUM' THEN 'TARGET2'
                WHEN '5-LOW' THEN 'unknown' END AS target, {ctrl} AS is_control
            FROM orders JOIN customer ON o_custkey = c_custkey {where}"""),
        ("counts", """SELECT cell_id, gene_id, sum(cnt) AS cnt FROM (
            SELECT l_orderkey AS cell_id, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS gene_id, l_quantity AS cnt
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT cell_id FROM obs0)
            UNION ALL
            SELECT cell_id, gene_id, CASE dose WHEN 10 THEN 20.0 WHEN 100 THEN 40.0 ELSE 60.0 END
            FROM obs0 JOIN planted USING (compound)) GROUP BY ALL"""),
        ("all_genes", """SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS gene_id,
            CASE p_brand WHEN 'Brand#24' THEN 'MT.' WHEN 'Brand#25' THEN 'mt-' ELSE '' END || p_brand AS gene FROM part"""),
        ("stats", f"""SELECT *, n_genes >= {min_genes} AS pass_min_genes, pct_mito <= {max_pct_mito} AS pass_mito,
            n_genes >= {min_genes} AND pct_mito <= {max_pct_mito} AS keep FROM (
            SELECT o.*, coalesce(n_genes, 0) AS n_genes, coalesce(total_count, 0) AS total_count, coalesce(mito, 0) AS mito_count,
                CASE WHEN coalesce(total_count, 0) > 0 THEN 100.0 * coalesce(mito, 0) / total_count ELSE 0 END AS pct_mito
            FROM obs0 o LEFT JOIN (SELECT cell_id, count(*) FILTER (cnt > 0) AS n_genes, sum(cnt) AS total_count,
                sum(cnt) FILTER (upper(gene) LIKE 'MT-%' OR upper(gene) LIKE 'MT.%') AS mito
                FROM counts JOIN all_genes USING (gene_id) GROUP BY 1) USING (cell_id))"""),
        ("detection", """SELECT gene_id, gene, coalesce(n, 0) AS n_detected, threshold, coalesce(n, 0) >= threshold AS keep
            FROM all_genes LEFT JOIN (SELECT gene_id, count(*) AS n FROM counts WHERE cnt > 0 GROUP BY 1) USING (gene_id),
            (SELECT CAST(greatest(3, ceil(CAST(0.01 AS DOUBLE) * count(*))) AS BIGINT) AS threshold FROM obs0)"""),
        ("genes", "SELECT gene_id, gene, row_number() OVER (ORDER BY gene_id) - 1 AS gene_idx FROM detection WHERE keep"),
        ("med", "SELECT quantile_cont(total_count, 0.5) AS m FROM stats WHERE total_count > 0"),
        ("expr", f"""SELECT s.cell_id, {KEYS}, batch, is_control, gene_idx, ln(1 + cnt / total_count * m) AS value
            FROM stats s JOIN counts USING (cell_id) JOIN genes USING (gene_id), med WHERE keep AND cnt <> 0"""),
    ]


def matching(min_cells: int = 10):
    return [
        ("sizes", f"SELECT {KEYS}, batch, is_control, count(*) AS n_cells FROM stats WHERE keep GROUP BY ALL"),
        ("ctrl0", "SELECT cell_line, batch, sum(n_cells) AS n_control FROM sizes WHERE is_control GROUP BY ALL"),
        ("pooled", "SELECT cell_line, sum(n_control) AS n_pooled FROM ctrl0 GROUP BY ALL"),
        ("tg0", f"""SELECT t.*, concat_ws('|', cell_line, compound, CAST(dose AS VARCHAR), CAST(time AS VARCHAR)) AS cond_id,
            c.n_control AS own, n_pooled,
            bool_or(c.n_control IS NOT NULL) OVER (PARTITION BY {KEYS}) AS any_match
            FROM sizes t LEFT JOIN ctrl0 c USING (cell_line, batch) LEFT JOIN pooled USING (cell_line) WHERE NOT t.is_control"""),
        ("tg1", f"""SELECT *, CASE WHEN own IS NOT NULL THEN batch WHEN NOT any_match AND n_pooled IS NOT NULL THEN '{FALLBACK}' END AS eff_batch,
            CASE WHEN any_match THEN own ELSE n_pooled END AS n_control FROM tg0"""),
        ("tg", f"""SELECT *, eff_batch IS NOT NULL AND n_total >= {min_cells} AS usable FROM (SELECT *,
            coalesce(sum(CASE WHEN eff_batch IS NOT NULL THEN n_cells END) OVER (PARTITION BY cond_id), 0) AS n_total FROM tg1)"""),
        ("pairs", """SELECT cond_id, cell_line, eff_batch, sum(n_cells) AS n_treated, max(n_control) AS n_control, max(n_total) AS n_total
            FROM tg WHERE usable GROUP BY ALL"""),
        ("targets", """SELECT compound, coalesce(min(CASE WHEN lower(target) NOT IN ('', 'nan', 'unknown') THEN target END), 'unknown') AS target
            FROM stats WHERE keep GROUP BY 1"""),
        ("conds", f"""SELECT cond_id, {KEYS}, ln(1 + dose) AS log_dose, array_to_string(list_sort(list(DISTINCT eff_batch)), ',') AS batch,
            CAST(sum(n_cells) AS BIGINT) AS n_cells, target FROM tg JOIN targets USING (compound) WHERE usable GROUP BY ALL"""),
    ]


def profiles():
    return [
        ("csum", "SELECT cell_line, batch, gene_idx, sum(value) AS s FROM expr WHERE is_control GROUP BY ALL"),
        ("cprof", f"""SELECT cell_line, batch AS eff_batch, gene_idx, s / n_control AS control FROM csum JOIN ctrl0 USING (cell_line, batch)
            UNION ALL SELECT cell_line, '{FALLBACK}', gene_idx, s / n_pooled FROM
            (SELECT cell_line, gene_idx, sum(s) AS s FROM csum GROUP BY ALL) JOIN pooled USING (cell_line)"""),
        ("texpr", f"SELECT e.cell_id, cond_id, e.cell_line, eff_batch, gene_idx, value FROM expr e JOIN tg USING ({KEYS}, batch) WHERE usable AND NOT e.is_control"),
        ("xs", "SELECT cond_id, gene_idx, sum(value) AS s FROM texpr GROUP BY ALL"),
        ("cs", "SELECT cond_id, gene_idx, sum(n_treated * control) / max(n_total) AS control FROM pairs JOIN cprof USING (cell_line, eff_batch) GROUP BY ALL"),
        ("prof", """SELECT c.*, gene_idx, gene, coalesce(s, 0) / n_cells AS x, coalesce(control, 0) AS control,
            coalesce(s, 0) / n_cells - coalesce(control, 0) AS delta
            FROM conds c CROSS JOIN genes LEFT JOIN xs USING (cond_id, gene_idx) LEFT JOIN cs USING (cond_id, gene_idx)"""),
    ]


Z_MAX = 37.065787880772135


def mwu():
    """Mann-Whitney by ranking the pooled cells of every (condition, batch, gene), zeros included."""
    return [
        ("pooled_vals", f"""SELECT cond_id, eff_batch, gene_idx, value, 1 AS t, 0 AS c FROM texpr
            UNION ALL SELECT p.cond_id, p.eff_batch, gene_idx, value, 0, 1 FROM pairs p JOIN expr e ON e.is_control AND e.cell_line = p.cell_line
            AND (e.batch = p.eff_batch OR p.eff_batch = '{FALLBACK}')"""),
        ("byval", "SELECT cond_id, eff_batch, gene_idx, value, sum(t) AS t, sum(c) AS c FROM pooled_vals GROUP BY ALL"),
        ("zeros", """SELECT cond_id, eff_batch, gene_idx, 0.0 AS value, n_treated - sum(t) AS t, n_control - sum(c) AS c
            FROM byval JOIN pairs USING (cond_id, eff_batch) GROUP BY cond_id, eff_batch, gene_idx, n_treated, n_control"""),
        ("blocks", "SELECT * FROM byval UNION ALL SELECT * FROM zeros WHERE t + c > 0"),
        ("ranked", """SELECT *, coalesce(sum(t + c) OVER (PARTITION BY cond_id, eff_batch, gene_idx ORDER BY value
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + c + 1) / 2.0 AS rank FROM blocks"""),
        ("ranksum", """SELECT cond_id, eff_batch, gene_idx, sum(t * rank) AS r1, sum(CAST(t + c AS DOUBLE) ** 3 - (t + c)) AS ties,
            sum(t * value) AS ts, sum(c * value) AS cs FROM ranked GROUP BY ALL"""),
        ("mw", f"""SELECT cond_id, eff_batch, gene_idx, n_treated, n_control, u,
            CASE WHEN v > 0 THEN least(greatest((abs(u - n_treated * n_control / 2.0) - 0.5) / sqrt(v), 0), {Z_MAX}) ELSE 0 END
            * CASE WHEN ts / n_treated < cs / n_control THEN -1 ELSE 1 END AS z FROM (
            SELECT *, r1 - n_treated * (n_treated + 1) / 2.0 AS u, n_treated * n_control / 12.0 * ((n_treated + n_control + 1)
            - ties / (CAST(n_treated + n_control AS DOUBLE) * (n_treated + n_control - 1))) AS v
            FROM ranksum JOIN pairs USING (cond_id, eff_batch) WHERE n_treated >= 2 AND n_control >= 2)"""),
        ("stouffer", """SELECT cond_id, gene_idx, sum(sqrt(n_treated) * z) / max(scale) AS z FROM mw JOIN
            (SELECT cond_id, sqrt(sum(n_treated)) AS scale FROM pairs WHERE n_treated >= 2 AND n_control >= 2 GROUP BY 1) USING (cond_id) GROUP BY ALL"""),
    ]


def bh(alpha: float = 0.05, n_genes: int = 25):
    from statistics import NormalDist

    cut = ", ".join(f"({k}, {-NormalDist().inv_cdf(alpha * k / n_genes / 2)!r})" for k in range(1, n_genes + 1))
    return [
        ("cuts", f"SELECT * FROM (VALUES {cut}) t(k, z_cut)"),
        ("bhrank", """SELECT cond_id, gene_idx, s.z, row_number() OVER (PARTITION BY cond_id ORDER BY abs(s.z) DESC, gene_idx) AS k FROM stouffer s"""),
        ("de", """SELECT cond_id, gene_idx, z FROM bhrank JOIN (SELECT cond_id, max(k) AS last FROM bhrank JOIN cuts USING (k)
            WHERE abs(z) >= z_cut GROUP BY 1) USING (cond_id) WHERE k <= last"""),
    ]


def halves(n_rep: int = 10, seed: int = 0):
    return [
        ("split", f"""SELECT cell_id, cond_id, eff_batch, rep, CASE WHEN row_number() OVER (PARTITION BY cond_id, eff_batch, rep
            ORDER BY md5(concat_ws('|', '{seed}', 'halves', rep, cell_id))) <= n_treated // 2 THEN 0 ELSE 1 END AS half
            FROM (SELECT s.cell_id, cond_id, eff_batch FROM stats s JOIN tg USING ({KEYS}, batch) WHERE s.keep AND usable AND NOT s.is_control)
            JOIN pairs USING (cond_id, eff_batch), range({n_rep}) r(rep) WHERE n_treated >= 2"""),
        ("hsum", "SELECT cond_id, rep, half, gene_idx, sum(value) AS s FROM texpr JOIN split USING (cell_id, cond_id, eff_batch) GROUP BY ALL"),
        ("hn", "SELECT cond_id, cell_line, eff_batch, rep, half, count(*) AS n FROM split JOIN pairs USING (cond_id, eff_batch) GROUP BY ALL"),
        ("hc", "SELECT cond_id, rep, half, gene_idx, sum(n * control) AS c FROM hn JOIN cprof USING (cell_line, eff_batch) GROUP BY ALL"),
        ("hw", "SELECT cond_id, rep, half, sum(n) AS n FROM hn GROUP BY ALL"),
        ("half", """SELECT cond_id, rep, half, gene_idx, (coalesce(s, 0) - coalesce(c, 0)) / n AS h FROM hw CROSS JOIN genes
            LEFT JOIN hsum USING (cond_id, rep, half, gene_idx) LEFT JOIN hc USING (cond_id, rep, half, gene_idx)"""),
    ]

"""ANSI-style SQL for each query, run on the same files by another engine."""

from __future__ import annotations

import re

from cohortile.plans.views import CONTRASTS, DECONV, SEGMENTS

VIEWS = {
    "samples": "SELECT n_name AS sample, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey",
    "expr_sparse": """SELECT CAST(l_partkey AS VARCHAR) AS feature, n_name AS sample, SUM(l_quantity) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "expr": """SELECT f.feature, s.sample, s.grp, COALESCE(e.value, 0.0) AS value
        FROM (SELECT DISTINCT feature FROM expr_sparse) f CROSS JOIN samples s
        LEFT JOIN expr_sparse e ON e.feature = f.feature AND e.sample = s.sample""",
    "expr_planted": """SELECT feature, sample, grp,
        (CASE CAST(feature AS INT) % 3 WHEN 0 THEN value + 20 WHEN 1 THEN (value + 20) * (value + 20)
         ELSE (value + 20) * (value + 20) * (value + 20) END)
        * (CASE WHEN CAST(feature AS INT) % 10 = 0 AND grp = 'ASIA' THEN 64
           WHEN CAST(feature AS INT) % 10 = 1 AND grp IN ('ASIA', 'AFRICA') THEN 64
           WHEN CAST(feature AS INT) % 10 = 2 AND grp = 'EUROPE' THEN 64 ELSE 1 END) AS value FROM expr""",
    "expr_raw": """SELECT CONCAT('P', CAST(p_partkey AS VARCHAR), '_', REPLACE(p_name, ' ', '_')) AS gene_id,
        e.sample AS biospecimen, e.grp, e.value FROM expr e JOIN part ON e.feature = CAST(p_partkey AS VARCHAR)""",
    "meta": """SELECT o_orderkey AS biospecimen, o_custkey AS sample_id, o_orderstatus AS comp,
        o_orderpriority AS strategy FROM orders""",
    "typed_meta": """SELECT DISTINCT biospecimen, sample_id,
        CASE comp WHEN 'F' THEN 'Suspension' WHEN 'O' THEN 'Adhesion' ELSE 'Solid_Tissue' END AS comp FROM meta""",
    "maf": """SELECT p_name AS symbol, CASE WHEN l_linenumber = 1 THEN '.'
        ELSE CONCAT(l_linestatus, CAST(l_linenumber AS VARCHAR)) END AS hgvsp,
        ROUND(l_discount * 10, 1) AS vaf, CONCAT(l_returnflag, '_', l_linestatus) AS vclass, l_orderkey AS biospecimen
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sv": "SELECT user_id AS biospecimen, event_type AS sv_type FROM events",
    "sv_meta": """SELECT DISTINCT user_id AS biospecimen, user_id % 20 AS sample_id,
        CASE user_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'A' ELSE 'T' END AS comp FROM events""",
    "gene_sets": """SELECT p_brand AS gs_name, CASE WHEN CAST(SUBSTRING(p_brand, 7) AS INT) <= 12 THEN 'C2' ELSE 'H' END AS category,
        CAST(p_partkey AS VARCHAR) AS feature FROM part
        UNION ALL SELECT CONCAT('SIZE_', CAST(p_size AS VARCHAR)), 'C5', CAST(p_partkey AS VARCHAR) FROM part""",
    "gene_set_blocks": """SELECT CONCAT('BLOCK_', CAST((p_partkey - 1) // 100 AS VARCHAR), '_', CASE WHEN (p_partkey - 1) % 100 < 60 THEN 'A'
        WHEN (p_partkey - 1) % 100 < 85 THEN 'B' WHEN (p_partkey - 1) % 100 < 97 THEN 'C' ELSE 'D' END) AS gs_name,
        'C3' AS category, CAST(p_partkey AS VARCHAR) AS feature FROM part""",
    "surface": "SELECT CAST(p_partkey AS VARCHAR) AS feature FROM part WHERE p_size <= 10",
    "goi": "SELECT DISTINCT p_name AS symbol FROM part WHERE p_name LIKE 'blue%'",
    "deconv": "SELECT n_name AS sample, " + ", ".join(
        f"COUNT(CASE WHEN o_orderpriority LIKE '{c}%' THEN 1 END) AS {n}" for n, c in DECONV
    ) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "deconv_long": " UNION ALL ".join(f"SELECT sample, '{n}' AS variable, {n} AS value FROM deconv" for n, _ in DECONV),
    "scores": "SELECT c_custkey, c_mktsegment AS grp, c_acctbal AS value FROM customer",
    "scaled_scores": """SELECT *, (value - MIN(value) OVER ()) / NULLIF(MAX(value) OVER () - MIN(value) OVER (), 0) AS scaled FROM scores""",
    "zs": """SELECT feature, sample, grp, (l - AVG(l) OVER w) / NULLIF(STDDEV_SAMP(l) OVER w, 0) AS value
        FROM (SELECT feature, sample, grp, LOG2(value + 1) AS l FROM expr) WINDOW w AS (PARTITION BY feature)""",
    "zr": "SELECT feature, sample, grp, ROUND(value, 9) + 0.0 AS value FROM zs WHERE value IS NOT NULL",
    # differential features with the ordinary t
    "logc": """SELECT feature, sample, grp, LOG2((value + 0.5) / (lib + 1) * 1e6) AS value
        FROM expr_planted JOIN (SELECT sample, SUM(value) AS lib FROM expr_planted GROUP BY sample) USING (sample)""",
    "fit_cells": "SELECT feature, grp, COUNT(value) AS n, AVG(value) AS mean, VAR_SAMP(value) AS v FROM logc GROUP BY feature, grp",
    "fit": """SELECT feature, grp, n, mean, CAST(SUM(n) OVER w - COUNT(*) OVER w AS BIGINT) AS df,
        SUM(COALESCE(v, 0) * (n - 1)) OVER w / NULLIF(SUM(n) OVER w - COUNT(*) OVER w, 0) AS s2
        FROM fit_cells WINDOW w AS (PARTITION BY feature)""",
    "contrasts": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in CONTRASTS) + ") AS t(contrast, grp_a, grp_b)",
    "est": """SELECT c.contrast, a.feature, a.mean - b.mean AS logfc, SQRT(1.0 / a.n + 1.0 / b.n) AS u, a.s2, a.df
        FROM contrasts c JOIN fit a ON a.grp = c.grp_a JOIN fit b ON b.grp = c.grp_b AND b.feature = a.feature""",
}


VIEWS["tagged"] = """SELECT feature, logfc, CASE contrast WHEN 'asia_vs_europe' THEN 'ASIA_vs_EUROPE' ELSE 'ASIA_vs_AFRICA' END AS label,
    CASE contrast WHEN 'asia_vs_europe' THEN 0 ELSE 1 END AS ord
    FROM mod_de WHERE adj_p < 0.05 AND contrast IN ('asia_vs_europe', 'asia_vs_africa') AND feature IN (SELECT feature FROM surface)"""
VIEWS["classed"] = """SELECT *, adj_p < 0.05 AS sig, CASE WHEN adj_p < 0.05 AND logfc > 1 THEN 'Up'
    WHEN adj_p < 0.05 AND logfc < -1 THEN 'Down' ELSE 'Unchanged' END AS de_class FROM mod_de"""
# gene sets
VIEWS["mapped"] = """SELECT gs_name, feature, set_size FROM (SELECT gs_name, feature, COUNT(*) OVER (PARTITION BY gs_name) AS set_size
    FROM (SELECT DISTINCT gs_name, feature FROM gene_sets WHERE feature IN (SELECT feature FROM expr_sparse)))
    WHERE set_size >= 1"""
VIEWS["placed"] = """SELECT feature, sample, value, COUNT(*) OVER (PARTITION BY sample) AS n,
    ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS p,
    FLOOR(RANK() OVER (PARTITION BY sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2.0) AS r FROM zr"""
VIEWS["es"] = """SELECT sample, gs_name, SUM(POW(r, 0.25) * (n + 1 - p)) / SUM(POW(r, 0.25))
    - (MAX(n) * (MAX(n) + 1) / 2.0 - SUM(n + 1 - p)) / NULLIF(MAX(n) - COUNT(*), 0) AS es
    FROM placed JOIN mapped USING (feature) GROUP BY sample, gs_name"""
VIEWS["ss"] = """SELECT *, es / NULLIF(MAX(es) OVER (PARTITION BY gs_name) - MIN(es) OVER (PARTITION BY gs_name), 0) AS score FROM es"""
VIEWS["walk"] = """SELECT sample, gs_name, n, p, ABS(n - p + 1 - n / 2.0) AS w,
    ROW_NUMBER() OVER (PARTITION BY sample, gs_name ORDER BY p) AS j, COUNT(*) OVER (PARTITION BY sample, gs_name) AS k
    FROM placed JOIN mapped USING (feature)"""
# variants
VIEWS["vaf_rows"] = """SELECT sample_id, comp, symbol, hgvsp, vaf FROM maf JOIN typed_meta USING (biospecimen)"""
VIEWS["vaf_arms"] = """SELECT DISTINCT a.sample_id, a.comp AS type FROM vaf_rows a
    JOIN vaf_rows b ON a.sample_id = b.sample_id AND b.comp = 'Solid_Tissue' WHERE a.comp <> 'Solid_Tissue'"""
VIEWS["vaf_reduced"] = """SELECT sample_id, comp, symbol, hgvsp, MAX(vaf) AS vaf, COUNT(*) AS n FROM vaf_rows
    WHERE hgvsp <> '.' AND symbol <> 'Unknown' GROUP BY ALL"""
VIEWS["vaf_pairs"] = """SELECT s.sample_id, s.type, r.symbol, r.symbol || '_' || r.hgvsp AS variant,
    COALESCE(MAX(CASE WHEN r.comp = 'Solid_Tissue' THEN r.vaf END), 0) AS vaf_ref,
    COALESCE(MAX(CASE WHEN r.comp = s.type THEN r.vaf END), 0) AS vaf_type, CAST(SUM(r.n) AS BIGINT) AS n_rows
    FROM vaf_arms s JOIN vaf_reduced r ON r.sample_id = s.sample_id AND r.comp IN ('Solid_Tissue', s.type) GROUP BY ALL"""
# group tests
VIEWS["pairs"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for i, a in enumerate(SEGMENTS) for b in SEGMENTS[i + 1:]) + ") AS t(grp_a, grp_b)"
VIEWS["pair_ranks"] = """SELECT grp_a, grp_b, grp = grp_a AS is_a,
    RANK() OVER (PARTITION BY grp_a, grp_b ORDER BY value) + (COUNT(*) OVER (PARTITION BY grp_a, grp_b, value) - 1) / 2.0 AS r,
    COUNT(*) OVER (PARTITION BY grp_a, grp_b, value) AS t
    FROM pairs JOIN scores ON grp IN (grp_a, grp_b)"""
VIEWS["pair_stats"] = """SELECT grp_a, grp_b, CAST(COUNT(*) FILTER (is_a) AS BIGINT) AS n_a, CAST(COUNT(*) FILTER (NOT is_a) AS BIGINT) AS n_b,
    CAST(SUM(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS tie_sum,
    SUM(r) FILTER (is_a) - COUNT(*) FILTER (is_a) * (COUNT(*) FILTER (is_a) + 1) / 2.0 AS w FROM pair_ranks GROUP BY grp_a, grp_b"""
VIEWS["pair_z"] = """SELECT *, (ABS(w - n_a * n_b / 2.0) - CASE WHEN w = n_a * n_b / 2.0 THEN 0 ELSE 0.5 END)
    / SQRT(CAST(n_a AS DOUBLE) * n_b / 12 * ((n_a + n_b + 1) - tie_sum / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1)))) AS z FROM pair_stats"""


def _kruskal(source: str, by: str = "") -> str:
    part, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT {lead}CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df, h FROM (
        SELECT *, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (CASE WHEN 1 - ties / (n * n * n - n) > 1e-12
            THEN 1 - ties / (n * n * n - n) END) AS h FROM (
        SELECT {lead}CAST(SUM(m) AS DOUBLE) AS n, COUNT(*) AS k, SUM(sr * sr / m) AS s, SUM(ties) AS ties FROM (
            SELECT {lead}grp, COUNT(*) AS m, SUM(r) AS sr, SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM (
                SELECT {lead}grp, RANK() OVER ({part} ORDER BY value) + (COUNT(*) OVER (PARTITION BY {lead}value) - 1) / 2.0 AS r,
                    COUNT(*) OVER (PARTITION BY {lead}value) AS t FROM {source})
            GROUP BY {lead}grp) {'GROUP BY ' + by if by else ''}))"""


VIEWS["kw"] = _kruskal("scores")
VIEWS["kw_feature"] = _kruskal("expr", "feature")
P4 = "EXP(-h / 2) * (1 + h / 2)"
P_NORMAL = """CASE WHEN z <= 0 THEN 1.0 ELSE 1 - 2 * EXP(-z * z / 2) / SQRT(2 * PI()) * z * list_reduce(
    list_prepend(1.0::DOUBLE, list_reverse(range(1, 400)::DOUBLE[])), lambda acc, k: 1 + acc * z * z / (2 * k + 1)) END"""

# variance moderation: digamma and trigamma by 20 recurrence steps and the asymptotic series,
# trigamma inverse by bisection on a log scale
def _psi(x: str) -> str:
    y = f"({x} + 20)"
    return (f"(LN({y}) - 1 / (2 * {y}) - 1 / (12 * POW({y}, 2)) + 1 / (120 * POW({y}, 4)) - 1 / (252 * POW({y}, 6))"
            f" - list_sum(list_transform(range(0, 20)::DOUBLE[], lambda k: 1 / ({x} + k))))")


def _tri(x: str) -> str:
    y = f"({x} + 20)"
    return (f"(1 / {y} + 1 / (2 * POW({y}, 2)) + 1 / (6 * POW({y}, 3)) - 1 / (30 * POW({y}, 5)) + 1 / (42 * POW({y}, 7))"
            f" + list_sum(list_transform(range(0, 20)::DOUBLE[], lambda k: 1 / POW({x} + k, 2))))")


def _beta_tail(a: str, b: str, x: str, depth: int = 300) -> str:
    """Regularised incomplete beta, continued fraction evaluated from the inside out."""
    m = "FLOOR(k / 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    fraction = (f"list_reduce(list_prepend(1.0::DOUBLE, list_reverse(range(1, {depth})::DOUBLE[])), "
                f"lambda acc, k: 1 + (CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END) / acc)")
    front = f"EXP({a} * LN({x}) + {b} * LN(1 - {x}) + LGAMMA({a} + {b}) - LGAMMA({a}) - LGAMMA({b}))"
    return f"({front} / {a} / {fraction})"


def _t_tail(df: str) -> str:
    """Two-sided tail from columns t, x = df / (df + t^2), y = 1 - x formed without cancellation."""
    return (f"CASE WHEN t = 0 THEN 1.0 WHEN x < ({df} / 2 + 1) / ({df} / 2 + 2.5) THEN {_beta_tail(f'({df} / 2)', '0.5::DOUBLE', 'x')} "
            f"ELSE 1 - {_beta_tail('0.5::DOUBLE', f'({df} / 2)', 'y')} END")


def _moderated(prefix: str, fit: str, est: str, by: str = "") -> None:
    """Views <prefix>_prior, _mod (per feature), _t and _de for one fit."""
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    using = f"USING ({by})" if by else "ON TRUE"
    part = f"PARTITION BY {by}" if by else ""
    VIEWS[f"{prefix}_var"] = f"SELECT {lead}feature, MAX(s2) AS s2, CAST(MAX(df) AS DOUBLE) AS df FROM {fit} GROUP BY {lead}feature"
    VIEWS[f"{prefix}_floor"] = f"""SELECT *, GREATEST(s2, floor) AS x FROM (SELECT *, CASE WHEN med > 0 THEN med ELSE 1 END * 1e-5 AS floor
        FROM (SELECT *, MEDIAN(s2) OVER ({part}) AS med FROM {prefix}_var))"""
    VIEWS[f"{prefix}_mom"] = f"""SELECT {lead}AVG(LN(x) - {_psi('(df / 2)')} + LN(df / 2)) AS emean,
        VAR_SAMP(LN(x) - {_psi('(df / 2)')} + LN(df / 2)) - AVG({_tri('(df / 2)')}) AS evar,
        AVG(x) AS xmean, MAX(floor) AS floor, SUM(df) AS pooled_df, COUNT(*) AS n_features FROM {prefix}_floor {group}"""
    VIEWS[f"{prefix}_bisect"] = f"""WITH RECURSIVE b AS (SELECT *, -20.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS i FROM {prefix}_mom
        UNION ALL SELECT * EXCLUDE (lo, hi, i, mid, up), CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, i + 1 FROM (
            SELECT *, (lo + hi) / 2 AS mid, {_tri('EXP((lo + hi) / 2)')} > evar AS up FROM b WHERE i < 70)) SELECT * FROM b WHERE i = 70"""
    VIEWS[f"{prefix}_prior"] = f"""SELECT {lead}floor, pooled_df, n_features, d0,
        CASE WHEN evar > 0 THEN EXP(emean + {_psi('(d0 / 2)')} - LN(d0 / 2)) ELSE xmean END AS s0_2, evar FROM (
        SELECT *, 2 * EXP((lo + hi) / 2) AS d0 FROM {prefix}_bisect)"""
    VIEWS[f"{prefix}_t"] = f"""SELECT *, dft / (dft + t * t) AS x, t * t / (dft + t * t) AS y FROM (
        SELECT {lead}contrast, feature, logfc, LEAST(d0 + df, pooled_df) AS dft, logfc / (u * SQRT(CASE WHEN evar > 0
            THEN (d0 * s0_2 + df * GREATEST(s2, floor)) / (d0 + df) ELSE s0_2 END)) AS t FROM {est} JOIN {prefix}_prior {using})"""
    VIEWS[f"{prefix}_p"] = f"SELECT {lead}contrast, feature, logfc, t, {_t_tail('dft')} AS p_value FROM {prefix}_t"
    VIEWS[f"{prefix}_de"] = f"""SELECT *, LEAST(1.0, MIN(q) OVER (PARTITION BY {lead}contrast ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj_p
        FROM (SELECT *, p_value * COUNT(p_value) OVER (PARTITION BY {lead}contrast)
        / COUNT(p_value) OVER (PARTITION BY {lead}contrast ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM {prefix}_p)"""


_moderated("mod", "fit", "est")
VIEWS["null_logc"] = VIEWS["logc"].replace("expr_planted", "expr")
VIEWS["null_cells"] = VIEWS["fit_cells"].replace("FROM logc", "FROM null_logc")
VIEWS["null_fit"] = VIEWS["fit"].replace("FROM fit_cells", "FROM null_cells")
_moderated("null", "null_fit", "est")
VIEWS["st_counts"] = """SELECT feature, sample, value, 'S' || CAST(CAST(SPLIT_PART(sample, '_', 2) AS INT) % 2 AS VARCHAR) AS stratum,
    CASE WHEN grp IN ('ASIA', 'AFRICA') THEN 'Y' ELSE 'N' END AS mut FROM expr_planted"""
VIEWS["st_logc"] = """SELECT stratum, feature, sample, mut, LOG2((value + 0.5) / (lib + 1) * 1e6) AS value
    FROM st_counts JOIN (SELECT stratum, sample, SUM(value) AS lib FROM st_counts GROUP BY stratum, sample) USING (stratum, sample)"""
VIEWS["st_fit"] = """SELECT stratum, feature, mut, n, mean, SUM(n) OVER w - COUNT(*) OVER w AS df,
    SUM(COALESCE(v, 0) * (n - 1)) OVER w / (SUM(n) OVER w - COUNT(*) OVER w) AS s2 FROM (
    SELECT stratum, feature, mut, COUNT(value) AS n, AVG(value) AS mean, VAR_SAMP(value) AS v FROM st_logc GROUP BY ALL)
    WINDOW w AS (PARTITION BY stratum, feature)"""
VIEWS["st_est"] = """SELECT a.stratum, 'Y_vs_N' AS contrast, a.feature, a.mean - b.mean AS logfc, SQRT(1.0 / a.n + 1.0 / b.n) AS u, a.s2, CAST(a.df AS DOUBLE) AS df
    FROM st_fit a JOIN st_fit b ON a.stratum = b.stratum AND a.feature = b.feature AND a.mut = 'Y' AND b.mut = 'N'"""
_moderated("st", "st_fit", "st_est", "stratum")

# exact rank-sum null of 5 against 5: every choice of 5 ranks out of 10
VIEWS["dist55"] = """SELECT a.i + b.i + c.i + d.i + e.i - 15 AS u FROM range(1, 11) a(i), range(1, 11) b(i), range(1, 11) c(i), range(1, 11) d(i), range(1, 11) e(i)
    WHERE a.i < b.i AND b.i < c.i AND c.i < d.i AND d.i < e.i"""
VIEWS["tails55"] = """SELECT w.u AS w, LEAST(1.0, 2.0 * CASE WHEN w.u > 12.5 THEN (SELECT COUNT(*) FROM dist55 x WHERE x.u >= w.u)
    ELSE (SELECT COUNT(*) FROM dist55 x WHERE x.u <= w.u) END / 252) AS p FROM (SELECT DISTINCT u FROM dist55) w"""


def _rank_sum(source: str, by: str, pairs: list[tuple[str, str]]) -> str:
    """Five-a-side rank-sum tests of listed pairs per ``by``: exact without ties, else normal."""
    listed = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") AS pr(grp_a, grp_b)"
    return f"""SELECT {by}, grp_a, grp_b, n_a, n_b, tie_sum, s.w, tie_sum = 0 AS exact,
        ROUND(CASE WHEN tie_sum = 0 THEN p ELSE {P_NORMAL} END, 6) + 0.0 AS p_value FROM (
        SELECT *, (ABS(w - 12.5) - CASE WHEN w = 12.5 THEN 0 ELSE 0.5 END) / NULLIF(SQRT(25 / 12.0 * (11 - tie_sum / 90)), 0) AS z FROM (
        SELECT {by}, grp_a, grp_b, COUNT(*) FILTER (is_a) AS n_a, COUNT(*) FILTER (NOT is_a) AS n_b,
            CAST(SUM(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS tie_sum, SUM(r) FILTER (is_a) - 15.0 AS w FROM (
            SELECT {by}, grp_a, grp_b, grp = grp_a AS is_a, COUNT(*) OVER (PARTITION BY {by}, grp_a, grp_b, value) AS t,
            RANK() OVER (PARTITION BY {by}, grp_a, grp_b ORDER BY value)
                + (COUNT(*) OVER (PARTITION BY {by}, grp_a, grp_b, value) - 1) / 2.0 AS r
            FROM {source} JOIN {listed} ON grp IN (grp_a, grp_b)) GROUP BY {by}, grp_a, grp_b)) s LEFT JOIN tails55 ON tails55.w = s.w"""


_PHI_DENSITY = "EXP(-z * z / 2) / SQRT(2 * PI())"
_PHI = f"""CASE WHEN ABS(z) < 3 THEN 0.5 + z * {_PHI_DENSITY} * list_reduce(
        list_prepend(1.0::DOUBLE, list_reverse(range(1, 40)::DOUBLE[])), lambda acc, k: 1 + acc * z * z / (2 * k + 1))
    WHEN z > 0 THEN 1 - {_PHI_DENSITY} / list_reduce(list_prepend(z, list_reverse(range(1, 70)::DOUBLE[])), lambda acc, k: z + k / acc)
    ELSE {_PHI_DENSITY} / list_reduce(list_prepend(-z, list_reverse(range(1, 70)::DOUBLE[])), lambda acc, k: k / acc - z) END"""
VIEWS["kernel_pairs"] = f"""SELECT feature, sa, sb, {_PHI} AS phi FROM (SELECT a.feature, a.sample AS sa, b.sample AS sb, (a.value - b.value) / a.h AS z
    FROM kernel_in a JOIN kernel_in b ON a.feature = b.feature AND a.sample < b.sample)"""
VIEWS["kernel_in"] = """SELECT feature, sample, value, STDDEV_SAMP(value) OVER (PARTITION BY feature) / 4 AS h FROM zs WHERE value IS NOT NULL"""
VIEWS["kernel"] = """SELECT feature, sample, (0.5 + SUM(phi)) / (COUNT(*) + 1) AS f FROM (
    SELECT feature, sa AS sample, phi FROM kernel_pairs UNION ALL SELECT feature, sb, 1 - phi FROM kernel_pairs) GROUP BY feature, sample"""
VIEWS["kplaced"] = """SELECT feature, sample, COUNT(*) OVER (PARTITION BY sample) AS n,
    ROW_NUMBER() OVER (PARTITION BY sample ORDER BY ROUND(f, 9) DESC, feature) AS p FROM kernel"""
VIEWS["kwalk"] = VIEWS["walk"].replace("FROM placed", "FROM kplaced")
VIEWS["scored_groups"] = "SELECT gs_name, grp, ROUND(score, 9) AS value FROM ss JOIN samples USING (sample)"

# both other readings of the grouped tests
VIEWS["sets_by_type"] = "SELECT grp AS type, gs_name AS grp, value FROM scored_groups WHERE value IS NOT NULL"
VIEWS["kw_sets"] = _kruskal("sets_by_type", "type")
VIEWS["pooled_rows"] = """SELECT grp_a, grp_b, grp = grp_a AS is_a, COUNT(*) OVER (PARTITION BY grp_a, grp_b, value) AS t,
    RANK() OVER (PARTITION BY grp_a, grp_b ORDER BY value) + (COUNT(*) OVER (PARTITION BY grp_a, grp_b, value) - 1) / 2.0 AS r
    FROM scored_groups JOIN (VALUES ('ASIA', 'EUROPE'), ('ASIA', 'AFRICA'), ('EUROPE', 'AFRICA')) AS pr(grp_a, grp_b)
        ON grp IN (grp_a, grp_b) WHERE value IS NOT NULL"""
VIEWS["pooled_z"] = """SELECT *, (ABS(w - n_a * n_b / 2.0) - CASE WHEN w = n_a * n_b / 2.0 THEN 0 ELSE 0.5 END)
    / SQRT(CAST(n_a AS DOUBLE) * n_b / 12 * ((n_a + n_b + 1) - tie_sum / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1)))) AS z FROM (
    SELECT grp_a, grp_b, COUNT(*) FILTER (is_a) AS n_a, COUNT(*) FILTER (NOT is_a) AS n_b, CAST(SUM(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS tie_sum,
        SUM(r) FILTER (is_a) - COUNT(*) FILTER (is_a) * (COUNT(*) FILTER (is_a) + 1) / 2.0 AS w FROM pooled_rows GROUP BY grp_a, grp_b)"""

# Shapiro-Wilk: normal scores by bisection, then the published weights and p-value
VIEWS["sw_rows"] = """SELECT grp, value, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY value) AS i, COUNT(*) OVER (PARTITION BY grp) AS n FROM (
    SELECT r_name || '_' || CAST(s_suppkey // 1000 AS VARCHAR) AS grp, s_acctbal AS value
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
VIEWS["sw_scores"] = f"""WITH RECURSIVE b AS (SELECT grp, value, i, n, (i - 0.375) / (n + 0.25) AS q, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS k FROM sw_rows
    UNION ALL SELECT grp, value, i, n, q, CASE WHEN up THEN z ELSE lo END, CASE WHEN up THEN hi ELSE z END, k + 1 FROM (
        SELECT *, {_PHI} < q AS up FROM (SELECT *, (lo + hi) / 2 AS z FROM b WHERE k < 60)))
    SELECT grp, value, i, n, (lo + hi) / 2 AS m FROM b WHERE k = 60"""
VIEWS["sw_sums"] = """SELECT grp, CAST(n AS DOUBLE) AS n, 1 / SQRT(n) AS u, SUM(m * m) AS mm, MAX(m) AS m1, MAX(m) FILTER (i = n - 1) AS m2,
    SUM(m * value) AS mx, MAX(value) - MIN(value) AS ends, MAX(value) FILTER (i = n - 1) - MAX(value) FILTER (i = 2) AS inner_ends,
    VAR_SAMP(value) * (n - 1) AS ss FROM sw_scores WHERE n >= 3 GROUP BY grp, n"""
VIEWS["sw_w"] = """SELECT grp, n, LEAST(1.0, CASE WHEN n = 3 THEN ends * ends / 2
    WHEN n <= 5 THEN POW(a1 * ends + (mx - m1 * ends) / SQRT((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)), 2)
    ELSE POW(a1 * ends + a2 * inner_ends + (mx - m1 * ends - m2 * inner_ends)
        / SQRT((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) END / ss) AS w FROM (SELECT *,
    m1 / SQRT(mm) + 0.221157 * u - 0.147981 * POW(u, 2) - 2.07119 * POW(u, 3) + 4.434685 * POW(u, 4) - 2.706056 * POW(u, 5) AS a1,
    m2 / SQRT(mm) + 0.042981 * u - 0.293762 * POW(u, 2) - 1.752461 * POW(u, 3) + 5.682633 * POW(u, 4) - 3.582633 * POW(u, 5) AS a2 FROM sw_sums)"""
VIEWS["sw_z"] = """SELECT grp, n, w, CAST(CASE WHEN n <= 11 THEN
        (-LN(-2.273 + 0.459 * n - LN(1 - w)) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n))
        / EXP(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
    ELSE (LN(1 - w) - (-1.5861 - 0.31082 * LN(n) - 0.083751 * POW(LN(n), 2) + 0.0038915 * POW(LN(n), 3)))
        / EXP(-0.4803 - 0.082676 * LN(n) + 0.0030302 * POW(LN(n), 2)) END AS DOUBLE) AS z FROM sw_w"""


def _with(body: str) -> str:
    """Prefix the views a statement needs, in dependency order."""
    order: list[str] = []

    def add(sql: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                add(VIEWS[name])
                order.append(name)

    add(body)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" if order else "") + body


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"ROUND({n}, {digits}) + 0.0 AS {n}" for n in names)


def _number(c: str) -> str:
    return f"CASE WHEN {c} = FLOOR({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


TAB = "CHR(9)"
_BASE = {
    "src_tsv_roundtrip": "SELECT symbol, hgvsp, vaf, vclass, biospecimen FROM maf",
    "src_gz_tsv": "SELECT * FROM sv",
    "src_list_roundtrip": "SELECT * FROM surface",
    "src_signature_roundtrip": "SELECT CAST(p_partkey AS VARCHAR) AS feature, p_retailprice AS weight FROM part",
    "matrix_load": "SELECT feature, sample, grp, value FROM expr",
    "sheet_version": "SELECT DISTINCT biospecimen, sample_id FROM meta WHERE comp = 'P'",
    "export_mixture": f"""SELECT 1 AS section, '' AS name, '!Sample_title' || {TAB} || STRING_AGG(sample, {TAB} ORDER BY sample) AS line FROM samples
        UNION ALL SELECT 9, feature, feature || {TAB} || STRING_AGG({_number('value')}, {TAB} ORDER BY sample) FROM expr GROUP BY feature""",
    "export_gct": f"""SELECT 1 AS section, '' AS name, '#1.2' AS line
        UNION ALL SELECT 2, '', (SELECT CAST(COUNT(DISTINCT feature) AS VARCHAR) FROM expr) || {TAB} || CAST(COUNT(*) AS VARCHAR)
            FROM samples WHERE grp IN ('ASIA', 'EUROPE')
        UNION ALL SELECT 3, '', 'NAME' || {TAB} || 'Description' || {TAB} || STRING_AGG(sample, {TAB} ORDER BY grp, sample)
            FROM samples WHERE grp IN ('ASIA', 'EUROPE')
        UNION ALL SELECT 9, feature, feature || {TAB} || 'na' || {TAB} || STRING_AGG({_number('value')}, {TAB} ORDER BY grp, sample)
            FROM expr WHERE grp IN ('ASIA', 'EUROPE') GROUP BY feature""",
    "export_cls": """SELECT 1 AS section, CAST(COUNT(*) AS VARCHAR) || ' 2 1' AS line FROM samples WHERE grp IN ('ASIA', 'EUROPE')
        UNION ALL SELECT 2, '# Asia Europe'
        UNION ALL SELECT 3, STRING_AGG(grp, ' ' ORDER BY grp, sample) FROM samples WHERE grp IN ('ASIA', 'EUROPE')""",
    "meta_select": "SELECT DISTINCT biospecimen, sample_id, comp FROM meta WHERE strategy = '1-URGENT'",
    "meta_merge": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS participant, CAST(o_orderkey AS VARCHAR) AS biospecimen,
            NULLIF(o_orderpriority, '5-LOW') AS descriptor, NULLIF(o_custkey % 7, 0) AS stage, o_orderstatus, o_orderpriority FROM orders),
        m AS (SELECT participant, biospecimen, descriptor, stage, o_orderstatus AS composition_type FROM o WHERE o_orderstatus = 'F')
        SELECT DISTINCT participant, biospecimen, COALESCE(descriptor, '') AS descriptor, COALESCE(CAST(stage AS VARCHAR), '') AS stage, composition_type FROM (
            SELECT * FROM m UNION ALL SELECT participant, biospecimen, descriptor, stage, 'solid_tissue' FROM o
            WHERE participant IN (SELECT participant FROM m) AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""",
    "recode_group": """SELECT biospecimen, comp, CASE comp WHEN 'Suspension' THEN 1 WHEN 'Adhesion' THEN 2 ELSE 3 END AS comp_ord,
        CASE comp WHEN 'Suspension' THEN 'Suspension (s)' WHEN 'Adhesion' THEN 'Adhesion (a)' ELSE 'Solid Tissue (t)' END AS comp_label
        FROM typed_meta""",
    "label_parse": """SELECT label, kind, SPLIT_PART(label, '_', 1) AS sample_part, SUBSTRING(label, STRPOS(label, '_') + 1) AS type_part,
        REGEXP_REPLACE(label, '.*_', '') AS last_part, SPLIT_PART(label, '_', 1) || '_' || kind AS joined
        FROM (SELECT CONCAT('P', CAST(p_partkey AS VARCHAR), '_', REPLACE(p_name, ' ', '_')) AS label, LOWER(p_type) AS kind FROM part)""",
    "id_map": """SELECT CONCAT(CAST(p_partkey AS VARCHAR), '.', CAST(p_size AS VARCHAR)) AS versioned_id,
        CAST(p_partkey AS VARCHAR) AS id, p_name AS symbol FROM part WHERE p_partkey % 10 <> 0""",
    "train_labels": """SELECT *, label = 'L0' AS positive FROM (SELECT 'V.' || CAST(vec_id AS VARCHAR) AS uid,
        CASE WHEN label <> 9 THEN 'L' || CAST(label AS VARCHAR) WHEN vec_id % 2 = 0 THEN 'EB' ELSE 'ECTO' END AS label FROM embeddings)""",
    "align_check": """SELECT COUNT(*) FILTER (e.feature IS NOT NULL AND p.feature IS NOT NULL) AS n_matched,
        COUNT(*) FILTER (p.feature IS NULL) AS n_left_only, COUNT(*) FILTER (e.feature IS NULL) AS n_right_only
        FROM (SELECT DISTINCT feature FROM expr_sparse) e FULL JOIN
        (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS feature FROM part) p ON e.feature = p.feature""",
    "set_intersect": "SELECT feature FROM expr_sparse INTERSECT SELECT feature FROM surface",
    "sample_order": """SELECT label, type, ROW_NUMBER() OVER (ORDER BY type, label) AS ord FROM (SELECT label,
        CASE REGEXP_REPLACE(label, '.*_', '') WHEN 'asia' THEN 'Suspension' WHEN 'europe' THEN 'Adherence' ELSE 'Solid Tissue' END AS type
        FROM (SELECT sample || '_' || REPLACE(LOWER(grp), ' ', '_') AS label FROM samples))""",
    "snv_class_counts": "SELECT sample_id, comp, vclass, COUNT(*) AS n FROM maf JOIN (SELECT DISTINCT biospecimen, sample_id, comp FROM meta) USING (biospecimen) GROUP BY ALL",
    "sv_class_counts": "SELECT sample_id, comp, sv_type, COUNT(*) AS n FROM sv JOIN sv_meta USING (biospecimen) GROUP BY ALL",
    "variants_goi": """SELECT symbol, hgvsp, vaf, vclass, biospecimen, sample_id, comp FROM maf JOIN typed_meta USING (biospecimen)
        WHERE symbol IN (SELECT symbol FROM goi)""",
    "mutated_samples": """SELECT DISTINCT biospecimen, sample_id, comp FROM maf JOIN typed_meta USING (biospecimen)
        WHERE hgvsp <> '.' AND symbol IN (SELECT symbol FROM goi)""",
    "group_by_mutation": """SELECT biospecimen, comp, COALESCE(status, 'wt') AS status, COALESCE(known, FALSE) AS in_samples,
        comp || '_' || COALESCE(status, 'wt') AS mut_group
        FROM (SELECT DISTINCT biospecimen, comp, TRUE AS known FROM meta WHERE strategy = '1-URGENT') a FULL JOIN
        (SELECT DISTINCT biospecimen, 'mutated' AS status FROM maf WHERE hgvsp <> '.' AND symbol IN (SELECT symbol FROM goi)) b USING (biospecimen)""",
    "vaf_compare": """SELECT *, CASE WHEN of_interest THEN variant ELSE '' END AS label FROM (
        SELECT sample_id, type, variant, symbol IN (SELECT symbol FROM goi) AS of_interest, vaf_ref, vaf_type, n_rows,
        CASE WHEN vaf_type = vaf_ref THEN 'Common' WHEN vaf_type = 0 THEN 'Solid_Tissue' WHEN vaf_ref = 0 THEN type ELSE 'Common' END AS origin
        FROM vaf_pairs)""",
    "vaf_quadrants": """SELECT type, vaf_ref >= 0.1 AS ref_high, vaf_type >= 0.1 AS type_high, COUNT(*) AS n FROM vaf_pairs
        WHERE vaf_ref BETWEEN 0 AND 1 AND vaf_type BETWEEN 0 AND 1 GROUP BY ALL""",
    "matrix_build": """SELECT symbol, label, value FROM (
        SELECT gene_id, biospecimen || '_' || LOWER(grp) AS label, value FROM expr_raw WHERE grp IN ('ASIA', 'EUROPE', 'AFRICA'))
        JOIN (SELECT gene_id, symbol FROM (SELECT gene_id, symbol, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY m DESC, gene_id) AS k FROM (
            SELECT gene_id, SUBSTRING(gene_id, STRPOS(gene_id, '_') + 1) AS symbol, AVG(value) AS m, SUM(value) AS s FROM expr_raw
            WHERE grp IN ('ASIA', 'EUROPE', 'AFRICA') AND NOT CONTAINS(gene_id, '_blue_anvil') GROUP BY gene_id) WHERE s > 0) WHERE k = 1)
        USING (gene_id)""",
    "dedup_best": f"""SELECT symbol, gene_id, {_r('mean')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY mean DESC, gene_id) AS k
        FROM (SELECT gene_id, SUBSTRING(gene_id, STRPOS(gene_id, '_') + 1) AS symbol, AVG(value) AS mean FROM expr_raw GROUP BY gene_id)) WHERE k = 1""",
    "zscore": f"SELECT feature, sample, grp, {_r('value')} FROM zs",
    "center": "SELECT feature, sample, grp, ROUND(value - AVG(value) OVER (PARTITION BY feature), 6) + 0.0 AS value FROM expr",
    "log_cpm": f"SELECT feature, sample, grp, {_r('value')} FROM logc",
    "minmax_scale": f"SELECT c_custkey, grp, value, {_r('scaled')} FROM scaled_scores",
    "unpivot_long": "SELECT * FROM deconv_long",
    "matrix_transpose": "SELECT variable, " + ", ".join(
        f"MAX(CASE WHEN sample = 'NATION_{i}' THEN value END) AS \"NATION_{i}\"" for i in range(25)) + " FROM deconv_long GROUP BY variable",
    "dedup_profiles": """SELECT MIN(feature) AS feature, COUNT(*) AS n_copies FROM (SELECT feature, LIST(k ORDER BY grp) AS v FROM (
        SELECT feature, grp, COUNT(*) FILTER (value > 0) AS k FROM expr GROUP BY feature, grp) GROUP BY feature) GROUP BY v""",
    "rank_avg": """SELECT feature, sample, grp, value, RANK() OVER (PARTITION BY sample ORDER BY value)
        + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS rank FROM expr""",
    "group_means_fit": f"SELECT feature, grp, n, df, {_r('mean', 's2')} FROM fit",
    "contrast_logfc": f"SELECT contrast, feature, df, {_r('logfc', 'u', 's2')} FROM est",
    "bh_adjust": f"""SELECT feature, p_value, {_r('adj_p')} FROM (SELECT feature, p_value,
        LEAST(1.0, MIN(q) OVER (ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj_p FROM (
        SELECT *, p_value * COUNT(p_value) OVER () / COUNT(p_value) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q
        FROM (SELECT feature, ROUND({P4}, 9) AS p_value FROM kw_feature)))""",
    "de_split": """SELECT contrast, COUNT(*) AS n, COUNT(*) FILTER (adj_p < 0.05) AS n_sig, COUNT(*) FILTER (adj_p < 0.05 AND logfc > 0) AS n_up,
        COUNT(*) FILTER (adj_p < 0.05 AND logfc < 0) AS n_down, COUNT(*) FILTER (adj_p < 0.05 AND ABS(logfc) > 1) AS n_fold
        FROM mod_de GROUP BY contrast""",
    "deg_overlap_up": "SELECT feature, STRING_AGG(label, ', ' ORDER BY ord) AS labels, COUNT(*) AS n FROM tagged WHERE logfc > 0 GROUP BY feature",
    "deg_overlap_down": "SELECT feature, STRING_AGG(label, ', ' ORDER BY ord) AS labels, COUNT(*) AS n FROM tagged WHERE logfc < 0 GROUP BY feature",
    "deg_overlap_all": f"SELECT feature, {_r('logfc')}, label, COUNT(*) OVER (PARTITION BY feature) AS n FROM tagged",
    "set_overlap": """SELECT direction, CAST(SUM(a) AS BIGINT) AS n_a, CAST(SUM(b) AS BIGINT) AS n_b, COUNT(*) FILTER (a > 0 AND b > 0) AS n_ab FROM (
        SELECT direction, feature, COUNT(*) FILTER (ord = 0) AS a, COUNT(*) FILTER (ord = 1) AS b FROM (
            SELECT 'all' AS direction, * FROM tagged UNION ALL SELECT 'up', * FROM tagged WHERE logfc > 0
            UNION ALL SELECT 'down', * FROM tagged WHERE logfc < 0) GROUP BY direction, feature) GROUP BY direction""",
    "deg_concordant": """SELECT DISTINCT x.feature FROM mod_de x JOIN mod_de y ON x.feature = y.feature
        WHERE x.contrast = 'asia_vs_europe' AND y.contrast = 'asia_vs_africa' AND x.adj_p < 0.05 AND y.adj_p < 0.05
        AND ((x.logfc > 0 AND y.logfc > 0) OR (x.logfc < 0 AND y.logfc < 0))""",
    "volcano_classes": f"""SELECT contrast, feature, sig, de_class, {_r('logfc', 'adj_p')}, ROUND(-LOG10(adj_p), 6) + 0.0 AS neg_log10_p,
        de_class || ' (n = ' || CAST(COUNT(*) OVER (PARTITION BY contrast, de_class) AS VARCHAR) || ')' AS class_label
        FROM classed WHERE feature IN (SELECT feature FROM surface)""",
    "volcano_combined": f"""SELECT contrast, feature, sig, de_class, {_r('logfc', 'adj_p')}, ROUND(-LOG10(adj_p), 6) + 0.0 AS neg_log10_p,
        de_class || ' (n = ' || CAST(COUNT(*) OVER (PARTITION BY contrast, de_class) AS VARCHAR) || ')' AS class_label,
        feature IN (SELECT feature FROM surface) AS in_list, COUNT(*) OVER (PARTITION BY feature, de_class, sig) AS n,
        CASE WHEN COUNT(*) OVER (PARTITION BY feature, de_class, sig) = 1 THEN 'Unique' ELSE 'Common' END AS genes
        FROM classed WHERE contrast IN ('asia_vs_europe', 'asia_vs_africa')""",
    "wilcoxon_pairs": f"SELECT grp_a, grp_b, n_a, n_b, tie_sum, w, ROUND({P_NORMAL}, 6) + 0.0 AS p_value FROM pair_z",
    "kruskal": f"SELECT n, df, {_r('h')}, ROUND({P4}, 6) + 0.0 AS p_value FROM kw",
    "kruskal_by": f"SELECT feature, n, df, {_r('h')}, ROUND({P4}, 6) + 0.0 AS p_value FROM kw_feature",
    "box_stats": f"""SELECT event_type, COUNT(*) AS n, {_r('q1', 'median', 'q3')},
        ROUND(MIN(value) FILTER (inside), 6) + 0.0 AS low_whisker, ROUND(MAX(value) FILTER (inside), 6) + 0.0 AS high_whisker,
        COUNT(*) FILTER (NOT inside) AS n_outliers FROM (
        SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN (
            SELECT event_type, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS median, QUANTILE_CONT(value, 0.75) AS q3
            FROM events GROUP BY event_type) USING (event_type)) GROUP BY event_type, q1, median, q3""",
    "label_outliers": f"""SELECT CAST(c_custkey AS VARCHAR) AS name, grp, {_r('scaled')},
        CASE WHEN grp IN ('BUILDING', 'MACHINERY') AND scaled > 0.5 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS label FROM scaled_scores""",
    "feature_by_group": """SELECT feature, sample, grp, ROUND(LOG2(value + 1), 6) + 0.0 AS value FROM expr
        WHERE feature = (SELECT feature FROM expr_sparse GROUP BY feature ORDER BY SUM(value) DESC, feature LIMIT 1)""",
    "gene_set_select": "SELECT * FROM gene_sets WHERE category = 'C2'",
    "gene_set_mapped": "SELECT gs_name, feature, set_size FROM mapped",
    "ssgsea": f"SELECT sample, gs_name, {_r('es', 'score')} FROM ss",
    "enrichment_by_group": f"""SELECT gs_name, sample, {_r('score')}, type, CASE type WHEN 'Adherent' THEN 1 WHEN 'Solid_Tissue' THEN 2 ELSE 3 END AS type_ord,
        CASE type WHEN 'Adherent' THEN 'Adherent cells' WHEN 'Solid_Tissue' THEN 'Tumour' ELSE 'Suspension cells' END AS type_label FROM (
        SELECT gs_name, sample, score, CASE grp WHEN 'ASIA' THEN 'Suspension' WHEN 'EUROPE' THEN 'Adherent' ELSE 'Solid_Tissue' END AS type
        FROM ss JOIN samples USING (sample))""",
    "gsva_maxdev": """SELECT sample, gs_name, ROUND(CASE WHEN weight = 0 THEN NULL WHEN up > -down THEN up ELSE down END, 6) + 0.0 AS es FROM (
        SELECT sample, gs_name, MAX(tot) AS weight, GREATEST(0.0, MAX(c - miss)) AS up, LEAST(0.0, MIN(c - w / tot - miss)) AS down FROM (
            SELECT sample, gs_name, w, SUM(w) OVER (PARTITION BY sample, gs_name ORDER BY p) / SUM(w) OVER (PARTITION BY sample, gs_name) AS c,
            SUM(w) OVER (PARTITION BY sample, gs_name) AS tot, (p - j) / CAST(n - k AS DOUBLE) AS miss FROM walk) GROUP BY sample, gs_name)""",
    "top_markers": """SELECT cell_type, feature, CAST(rank AS INT) AS rank FROM (SELECT p_type AS cell_type, CAST(p_partkey AS VARCHAR) AS feature,
        ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
        WHERE CAST(p_partkey AS VARCHAR) IN (SELECT feature FROM expr_sparse)) WHERE rank <= 50""",
    "signature_score": """SELECT sample, ROUND(s, 6) + 0.0 AS score, ROUND((s - MIN(s) OVER ()) / (MAX(s) OVER () - MIN(s) OVER ()), 6) + 0.0 AS scaled FROM (
        SELECT sample, CORR(x, y) AS s FROM (SELECT sample,
            RANK() OVER (PARTITION BY sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS x,
            RANK() OVER (PARTITION BY sample ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY sample, p_retailprice) - 1) / 2.0 AS y
            FROM expr JOIN part ON feature = CAST(p_partkey AS VARCHAR)) GROUP BY sample)""",
    "sample_gram": """SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(SUM(a.value * b.value), 6) + 0.0 AS total
        FROM (SELECT feature, sample, (value - AVG(value) OVER (PARTITION BY feature)) / NULLIF(STDDEV_SAMP(value) OVER (PARTITION BY feature), 0) AS value FROM expr) a
        JOIN (SELECT feature, sample, (value - AVG(value) OVER (PARTITION BY feature)) / NULLIF(STDDEV_SAMP(value) OVER (PARTITION BY feature), 0) AS value FROM expr) b
        ON a.feature = b.feature AND a.sample <= b.sample GROUP BY 1, 2""",
    "sample_distance": """SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(SQRT(SUM((a.value - b.value) * (a.value - b.value))), 6) + 0.0 AS distance
        FROM expr a JOIN expr b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2""",
    "celltype_distance": """SELECT a.variable AS sample_a, b.variable AS sample_b, ROUND(SQRT(SUM(CAST((a.value - b.value) * (a.value - b.value) AS DOUBLE))), 6) + 0.0 AS distance
        FROM deconv_long a JOIN deconv_long b ON a.sample = b.sample AND a.variable < b.variable GROUP BY 1, 2""",
}
_BASE.update({
    "moderated_var": f"""SELECT feature, CAST(df AS BIGINT) AS df, {_r('s2', 'd0', 's0_2')},
        ROUND((d0 * s0_2 + df * GREATEST(s2, floor)) / (d0 + df), 6) + 0.0 AS s2_post, ROUND(LEAST(d0 + df, pooled_df), 6) + 0.0 AS df_total
        FROM mod_var JOIN mod_prior ON TRUE""",
    "moderated_prior_null": f"""SELECT {_r('s0_2', 'floor')}, CAST(pooled_df AS BIGINT) AS pooled_df, n_features, evar <= 0 AS d0_infinite FROM null_prior""",
    "moderated_t": f"SELECT contrast, feature, {_r('logfc', 't', 'p_value')} FROM mod_p",
    "de_table": f"SELECT contrast, feature, {_r('logfc', 't', 'p_value', 'adj_p')} FROM mod_de",
    "de_top": f"""SELECT contrast, feature, {_r('logfc', 't', 'p_value', 'adj_p')} FROM (
        SELECT * FROM mod_de WHERE contrast = 'asia_vs_europe' ORDER BY ABS(t) DESC, feature LIMIT 100)""",
    "de_by_stratum": f"SELECT stratum, contrast, feature, {_r('logfc', 't', 'p_value', 'adj_p')} FROM st_de WHERE adj_p < 0.05",
})
_BASE["gsva_kcdf"] = f"SELECT feature, sample, {_r('f')} FROM kernel"
_BASE["gsva"] = _BASE["gsva_maxdev"].replace("FROM walk", "FROM kwalk")
_BASE["wilcoxon_exact"] = _rank_sum("expr", "feature", [("ASIA", "EUROPE"), ("ASIA", "AFRICA")])
# the tail of chi-square is a finite sum for an even number of degrees, which 75 sets give
_BASE["enrichment_sets_by_type"] = f"""SELECT type, n, df, {_r('h')}, ROUND(EXP(-h / 2) * list_sum(list_transform(
    range(df // 2), lambda k: EXP(k * LN(h / 2) - lgamma(k + 1)))), 6) + 0.0 AS p_value FROM kw_sets"""
_BASE["enrichment_tests_pooled"] = f"SELECT grp_a, grp_b, n_a, n_b, tie_sum, w, ROUND({P_NORMAL}, 6) + 0.0 AS p_value FROM pooled_z"
_BASE["gene_set_block_limits"] = """SELECT gs_name, feature, set_size FROM (SELECT gs_name, feature, COUNT(*) OVER (PARTITION BY gs_name) AS set_size
    FROM (SELECT DISTINCT gs_name, feature FROM gene_set_blocks WHERE feature IN (SELECT feature FROM expr_sparse))) WHERE set_size BETWEEN 5 AND 45"""
_BASE["gene_set_limits"] = _BASE["gene_set_block_limits"].replace("BETWEEN 5 AND 45", "BETWEEN 10 AND 30")
_BASE["enrichment_tests"] = _rank_sum("scored_groups", "gs_name", [("ASIA", "EUROPE"), ("ASIA", "AFRICA"), ("EUROPE", "AFRICA")])
_BASE["shapiro"] = f"""SELECT g.grp, g.n, ROUND(w, 6) + 0.0 AS w, ROUND(CASE WHEN g.n = 3 THEN GREATEST(0.0, 6 / PI() * (ASIN(SQRT(w)) - ASIN(SQRT(0.75))))
    ELSE 1 - ({_PHI}) END, 6) + 0.0 AS p_value FROM (SELECT DISTINCT grp, n FROM sw_rows) g LEFT JOIN sw_z s ON s.grp = g.grp"""
# the same steps for each feature over its samples
VIEWS["swf_rows"] = """SELECT feature AS grp, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) AS i,
    COUNT(*) OVER (PARTITION BY feature) AS n FROM expr"""
for _view in ("scores", "sums", "w", "z"):
    VIEWS[f"swf_{_view}"] = VIEWS[f"sw_{_view}"].replace("FROM sw_", "FROM swf_")
VIEWS["swf_sums"] += " HAVING MAX(value) > MIN(value)"
_BASE["shapiro_by"] = _BASE["shapiro"].replace("SELECT g.grp,", "SELECT g.grp AS feature,").replace("FROM sw_rows", "FROM swf_rows").replace(
    "JOIN sw_z", "JOIN swf_z")
_BASE["snv_class_pivot"] = "SELECT sample_id, comp, " + ", ".join(
    f"CAST(SUM(CASE WHEN vclass = '{c}' THEN n END) AS BIGINT) AS \"{c}\"" for c in ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")
) + f" FROM ({_BASE['snv_class_counts']}) GROUP BY sample_id, comp"
_BASE["sv_class_pivot"] = "SELECT sample_id, comp, " + ", ".join(
    f"CAST(SUM(CASE WHEN sv_type = '{c}' THEN n END) AS BIGINT) AS \"{c}\"" for c in ("click", "error", "purchase", "signup", "view")
) + f" FROM ({_BASE['sv_class_counts']}) GROUP BY sample_id, comp"

# linear methods: leading vectors by repeated squaring, optima by gradient steps
SQUARINGS, STEPS = 60, 60


def _squared(source: str, by: str = "") -> str:
    """The outer product of the leading vector of every matrix (by, i, j, x) in ``source``."""
    key, on, part = (f"{by}, ", f" AND a.{by} = b.{by}", f"PARTITION BY {by}") if by else ("", "", "")
    own = f"a.{by}, " if by else ""
    return f"""WITH RECURSIVE sq AS (SELECT 0 AS it, {key}i, j, x / MAX(ABS(x)) OVER ({part}) AS x FROM {source}
        UNION ALL SELECT it + 1, {key}i, j, x / MAX(ABS(x)) OVER ({part}) FROM (
            SELECT a.it, {own}a.i, b.j, SUM(a.x * b.x) AS x FROM sq a JOIN sq b ON a.j = b.i{on} WHERE a.it < {SQUARINGS} GROUP BY a.it, {own}a.i, b.j))
        SELECT {key}i, j, x FROM sq WHERE it = {SQUARINGS}"""


def _vector(source: str, by: str = "") -> str:
    """The leading vector from that product: its column at the largest entry of the diagonal, at unit length."""
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    using = f"({by}, j)" if by else "(j)"
    return f"""SELECT {key}i, x / SQRT(d) AS v FROM {source} JOIN (SELECT {key}i AS j, x / SUM(x) OVER ({part}) AS share, x AS raw,
            x * SUM(x) OVER ({part}) AS d, ROW_NUMBER() OVER ({part} ORDER BY x DESC, i) AS k FROM {source} WHERE i = j) USING {using} WHERE k = 1"""


VIEWS["plain_z"] = """SELECT feature, sample, z FROM (SELECT feature, sample, (value - AVG(value) OVER w) / NULLIF(STDDEV_SAMP(value) OVER w, 0) AS z
    FROM expr WINDOW w AS (PARTITION BY feature)) WHERE z IS NOT NULL"""
VIEWS["gram1"] = "SELECT a.sample AS i, b.sample AS j, SUM(a.z * b.z) AS x FROM plain_z a JOIN plain_z b USING (feature) GROUP BY 1, 2"
VIEWS["square1"] = _squared("gram1")
VIEWS["vector1"] = _vector("square1")
VIEWS["value1"] = "SELECT SUM(a.v * x * b.v) AS size FROM gram1 g JOIN vector1 a ON a.i = g.i JOIN vector1 b ON b.i = g.j"
VIEWS["gram2"] = "SELECT g.i, g.j, x - size * a.v * b.v AS x FROM gram1 g JOIN vector1 a ON a.i = g.i JOIN vector1 b ON b.i = g.j JOIN value1 ON TRUE"
VIEWS["square2"] = _squared("gram2")
VIEWS["vector2"] = _vector("square2")
VIEWS["value2"] = VIEWS["value1"].replace("vector1", "vector2")
_BASE["pca_samples"] = f"""SELECT sample, {_r('pc1', 'pc2', digits=5)} FROM (
    SELECT a.i AS sample, a.v * SQRT(s.size) * SIGN(FIRST_VALUE(a.v) OVER (ORDER BY ABS(a.v) DESC)) AS pc1,
        b.v * SQRT(t.size) * SIGN(FIRST_VALUE(b.v) OVER (ORDER BY ABS(b.v) DESC)) AS pc2
    FROM vector1 a JOIN vector2 b ON b.i = a.i JOIN value1 s ON TRUE JOIN value2 t ON TRUE)"""
VIEWS["marker_z"] = f"""SELECT cell_type, feature, sample, z FROM (SELECT feature, sample, (l - AVG(l) OVER w) / NULLIF(STDDEV_SAMP(l) OVER w, 0) AS z
    FROM (SELECT feature, sample, LOG2(value + 1) AS l FROM expr) WINDOW w AS (PARTITION BY feature))
    JOIN ({_BASE['top_markers']}) USING (feature) WHERE z IS NOT NULL"""
VIEWS["marker_gram"] = """SELECT a.cell_type, a.sample AS i, b.sample AS j, SUM(a.z * b.z) AS x
    FROM marker_z a JOIN marker_z b USING (cell_type, feature) GROUP BY ALL"""
VIEWS["marker_square"] = _squared("marker_gram", "cell_type")
VIEWS["marker_vector"] = _vector("marker_square", "cell_type")
_BASE["marker_svd"] = """SELECT i AS sample, cell_type, ROUND(v * CASE WHEN total < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS score FROM marker_vector
    JOIN (SELECT m.cell_type, SUM(z * v) AS total FROM marker_z m JOIN marker_vector u ON u.cell_type = m.cell_type AND u.i = m.sample GROUP BY 1) USING (cell_type)"""
VIEWS["centred"] = """SELECT vec_id, label = 0 AS positive, LIST(CAST(x AS DOUBLE) - m ORDER BY k) AS x FROM (
    SELECT vec_id, label, k, x, AVG(CAST(x AS DOUBLE)) OVER (PARTITION BY k) AS m FROM (
        SELECT vec_id, label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS k FROM embeddings)) GROUP BY vec_id, label"""
VIEWS["trainers"] = "SELECT vec_id, x, CAST(ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS INT) AS fold FROM centred WHERE positive"


def _descent(seed: str, others: str, trainers: str = "trainers") -> str:
    """Models (fold, w) after gradient steps from 0; a step of 0.9 suits vectors of length about 1."""
    return f"""WITH RECURSIVE step AS (SELECT 0 AS it, fold, w FROM ({seed})
        UNION ALL SELECT it + 1, fold, LIST(w[k] - 0.9 * (w[k] - g) ORDER BY k) FROM (
            SELECT it, fold, ANY_VALUE(w) AS w, k, AVG((1 - p) * x[k]) AS g FROM (
                SELECT s.it, s.fold, s.w, t.x, 1 / (1 + EXP(-LIST_DOT_PRODUCT(t.x, s.w))) AS p FROM step s JOIN {trainers} t ON {others} WHERE s.it < {STEPS}),
            (SELECT UNNEST(RANGE(1, 65)) AS k) WHERE k <= LEN(x) GROUP BY it, fold, k) GROUP BY it, fold)
        SELECT fold, w FROM step WHERE it = {STEPS}"""


VIEWS["model"] = _descent("SELECT 0 AS fold, LIST_TRANSFORM(RANGE(64), lambda k: 0e0) AS w", "TRUE")
_BASE["oneclass_train"] = "SELECT CAST(k - 1 AS INT) AS feature, ROUND(w[k], 6) + 0.0 AS weight FROM model, (SELECT UNNEST(RANGE(1, 65)) AS k)"
VIEWS["fold_models"] = _descent("SELECT fold, LIST_TRANSFORM(RANGE(64), lambda k: 0e0) AS w FROM trainers", "t.fold <> s.fold")


def _ranked(source: str, key: str, column: str) -> str:
    """(key, r): the mean ranks of the entries of every list."""
    return f"""SELECT {key}, LIST(r ORDER BY k) AS r FROM (
        SELECT {key}, k, RANK() OVER (PARTITION BY {key} ORDER BY x) + (COUNT(*) OVER (PARTITION BY {key}, x) - 1) / 2.0 AS r
        FROM (SELECT {key}, k, ROUND({column}[k], 12) AS x FROM {source}, (SELECT UNNEST(RANGE(1, 65)) AS k))) GROUP BY {key}"""


VIEWS["fold_ranks"] = _ranked("fold_models", "fold", "w")
VIEWS["vector_ranks"] = _ranked("centred", "vec_id", "x")
VIEWS["rhos"] = """SELECT fold, vec_id, ROUND((64 * LIST_DOT_PRODUCT(f.r, v.r) - LIST_SUM(f.r) * LIST_SUM(v.r))
    / SQRT((64 * LIST_DOT_PRODUCT(f.r, f.r) - LIST_SUM(f.r) * LIST_SUM(f.r)) * (64 * LIST_DOT_PRODUCT(v.r, v.r) - LIST_SUM(v.r) * LIST_SUM(v.r))), 12) AS rho
    FROM fold_ranks f JOIN vector_ranks v ON TRUE"""
_BASE["loo_auc"] = f"""SELECT fold, {_r('auc')}, ROUND(AVG(auc) OVER (ORDER BY fold), 6) + 0.0 AS running_auc FROM (
    SELECT r.fold, AVG(CASE WHEN own > rho THEN 1.0 ELSE 0.0 END) AS auc FROM rhos r JOIN centred c ON c.vec_id = r.vec_id AND NOT c.positive
    JOIN (SELECT fold, rho AS own FROM rhos JOIN trainers USING (fold, vec_id)) o ON o.fold = r.fold GROUP BY r.fold)"""

VIEWS["chosen_ids"] = """SELECT symbol, MIN(id) AS id FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, p_name AS symbol FROM part
    WHERE p_partkey % 10 <> 0 AND p_partkey <= 64 AND p_name <> '' AND p_name IN (SELECT p_name FROM part WHERE p_size <= 30)) GROUP BY symbol"""
VIEWS["chosen_places"] = """SELECT symbol, CAST(id AS INT) AS k, ROW_NUMBER() OVER (ORDER BY symbol) AS place FROM chosen_ids"""
VIEWS["chosen_vectors"] = """SELECT vec_id, COALESCE(label, -1) = 0 AS positive, LIST(CAST(x AS DOUBLE) - m ORDER BY place) AS x FROM (
    SELECT vec_id, label, place, x, AVG(CAST(x AS DOUBLE)) OVER (PARTITION BY place) AS m FROM (
        SELECT vec_id, label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS k FROM embeddings) JOIN chosen_places USING (k)) GROUP BY vec_id, label"""
VIEWS["chosen_trainers"] = "SELECT x, 0 AS fold FROM chosen_vectors WHERE positive"
VIEWS["chosen_model"] = _descent("SELECT 0 AS fold, LIST_TRANSFORM(RANGE(COUNT(*)), lambda k: 0e0) AS w FROM chosen_places", "TRUE", "chosen_trainers")
_BASE["signature_pipeline"] = "SELECT symbol, ROUND(w[place], 6) + 0.0 AS weight FROM chosen_places JOIN chosen_model ON TRUE"
# exports by mutation
VIEWS["hit_counts"] = """SELECT n_name AS sample, 'S' || CAST(n_nationkey % 2 AS VARCHAR) AS stratum, COALESCE(n, 0) AS n FROM nation LEFT JOIN (
    SELECT c_nationkey, COUNT(*) AS n FROM maf JOIN orders ON o_orderkey = biospecimen JOIN customer ON o_custkey = c_custkey
    WHERE hgvsp <> '.' AND symbol IN (SELECT symbol FROM goi) GROUP BY 1) ON c_nationkey = n_nationkey"""
VIEWS["mutated_groups"] = """SELECT sample, CASE WHEN n > AVG(n) OVER (PARTITION BY stratum) THEN stratum || '_mutated' ELSE stratum || '_wt' END AS grp FROM hit_counts"""
_GROUPS = "('S0_mutated', 'S0_wt')"
_BASE["export_cls_mutation"] = _BASE["export_cls"].replace("FROM samples", "FROM mutated_groups").replace("('ASIA', 'EUROPE')", _GROUPS).replace("# Asia Europe", "# mutated wt")
_BASE["export_gct_mutation"] = _BASE["export_gct"].replace("FROM samples", "FROM mutated_groups").replace("FROM expr WHERE", "FROM (SELECT feature, sample, m.grp, value FROM expr JOIN mutated_groups m USING (sample)) WHERE").replace(
    "('ASIA', 'EUROPE')", _GROUPS)

ORACLE = {name: _with(sql) for name, sql in _BASE.items()}

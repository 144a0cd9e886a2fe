"""DuckDB statements for the hypothesis tests."""

from __future__ import annotations

from oracle.reports import case_bucket
from oracle.tables import half_up, money_mean


def r(x: str, digits: int = 6) -> str:
    return half_up(x, digits)


EXTRA = {
    "t_rows": """SELECT f.order_id, f.order_item_id, f.is_late, f.review_score, f.delivery_days,
        f.delivery_delay_days, c.customer_state
        FROM dated_items f JOIN cust c ON f.customer_unique_id = c.customer_unique_id
        WHERE f.review_score IS NOT NULL""",
    "t_top": "SELECT customer_state FROM t_rows GROUP BY 1 ORDER BY count(*) DESC, customer_state LIMIT 10",
    "t_groups": f"""SELECT customer_state, count(*) AS n, {money_mean("delivery_days")} AS mean,
        stddev_samp(delivery_days) AS sd, median(delivery_days) AS median
        FROM t_rows WHERE customer_state IN (SELECT customer_state FROM t_top) GROUP BY 1""",
    "t_late": """SELECT is_late, count(*) AS n, avg(review_score) AS mean, stddev_samp(review_score) AS sd,
        var_samp(review_score) AS v, median(review_score) AS median FROM t_rows GROUP BY 1""",
    "t_two": """SELECT a.n AS n1, a.mean AS m1, a.v AS v1, b.n AS n2, b.mean AS m2, b.v AS v2
        FROM (SELECT * FROM t_late WHERE is_late = 0) a, (SELECT * FROM t_late WHERE is_late = 1) b""",
    "t_ranked": """SELECT *,
        rank() OVER (ORDER BY delivery_delay_days) + (count(*) OVER (PARTITION BY delivery_delay_days) - 1) / 2 AS rx,
        rank() OVER (ORDER BY review_score) + (count(*) OVER (PARTITION BY review_score) - 1) / 2 AS ry FROM t_rows""",
    "t_kw": """SELECT customer_state,
        rank() OVER (ORDER BY delivery_days) + (count(*) OVER (PARTITION BY delivery_days) - 1) / 2 AS rk
        FROM t_rows WHERE customer_state IN (SELECT customer_state FROM t_top)""",
}


def _strength(x: str) -> str:
    return f"""CASE WHEN abs({x}) < 0.1 THEN 'negligible' WHEN abs({x}) < 0.3 THEN 'weak'
        WHEN abs({x}) < 0.5 THEN 'moderate' WHEN abs({x}) < 0.7 THEN 'strong' ELSE 'very strong' END AS strength,
        CASE WHEN {x} < 0 THEN 'negative' ELSE 'positive' END AS direction"""


def box(source: str, group: str, value: str) -> str:
    return f"""SELECT g.{group} AS class, {r("q1")} AS q1, {r("q2")} AS median, {r("q3")} AS q3,
        CAST(min(CASE WHEN {value} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1) THEN {value} END) AS DOUBLE) AS whisker_low,
        CAST(max(CASE WHEN {value} BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1) THEN {value} END) AS DOUBLE) AS whisker_high
        FROM ({source}) s JOIN (SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
              quantile_cont({value}, 0.75) AS q3 FROM ({source}) GROUP BY 1) g ON s.{group} = g.{group}
        GROUP BY g.{group}, q1, q2, q3"""


TERMS = 10_000


def _fold(term: str, last: str) -> str:
    """`term` of f and k for k from TERMS down to 1: a continued fraction or series from its last term."""
    return f"list_reduce(list_prepend(CAST({last} AS DOUBLE), range({TERMS}, 0, -1)), lambda f, k: {term})"


def _beta(a: str, b: str, x: str, rest: str) -> str:
    """The regularised incomplete beta function of x, `rest` being 1 - x."""

    def part(a: str, b: str, x: str) -> str:
        step = f"""CASE WHEN k % 2 = 0 THEN (k // 2) * ({b} - k // 2) * {x} / (({a} + k - 1) * ({a} + k))
            ELSE -({a} + k // 2) * ({a} + {b} + k // 2) * {x} / (({a} + k - 1) * ({a} + k)) END"""
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
        return f"{front} / {a} / {_fold(f'1 + ({step}) / f', '1')}"

    return f"""CASE WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {part(a, b, x)} ELSE 1 - {part(b, a, rest)} END"""


def _gamma(a: str, x: str) -> str:
    """The regularised upper incomplete gamma function."""
    front = f"exp({a} * ln({x}) - {x} - lgamma({a}))"
    return f"""CASE WHEN {x} < {a} + 1 THEN 1 - {front} / {a} * {_fold(f"1 + {x} / ({a} + k) * f", "1")}
        ELSE {front} / ({_fold(f"{x} + 2 * k - 1 - {a} + k * ({a} - k) / f", f"{x} + {2 * TERMS + 1} - {a}")}) END"""


def with_p(body: str, inner: str, p: str) -> str:
    """`body` with p and both flags, from columns of `inner`, the unrounded statistics."""
    return f"""SELECT {body}, {r("p")} AS p, p < 0.05 AS significant, p < 0.01 AS significant_01
        FROM (SELECT *, {p} AS p FROM ({inner}))"""


def p_t(t: str, df: str) -> str:
    df, square = f"CAST({df} AS DOUBLE)", f"({t}) * ({t})"
    return _beta(f"({df} / 2)", "0.5::DOUBLE", f"({df} / ({df} + {square}))", f"({square} / ({df} + {square}))")


def p_f(f: str, df1: str, df2: str) -> str:
    a, b = f"CAST({df1} AS DOUBLE)", f"CAST({df2} AS DOUBLE)"
    return _beta(f"({b} / 2)", f"({a} / 2)", f"({b} / ({b} + {a} * {f}))", f"({a} * {f} / ({b} + {a} * {f}))")


def p_chi2(x: str, df: str) -> str:
    return _gamma(f"(CAST({df} AS DOUBLE) / 2)", f"({x} / 2)")


def p_normal(z: str) -> str:
    return f"CASE WHEN {z} <= 0 THEN 1 ELSE {_gamma('0.5::DOUBLE', f'({z} * {z} / 2)')} END"


SQL: dict[str, str] = {}
INNER = {
    "pearson": "SELECT count(*) AS n, corr(delivery_delay_days, review_score) AS x FROM t_rows",
    "spearman": "SELECT count(*) AS n, corr(rx, ry) AS x FROM t_ranked",
    "welch_t": """SELECT (m1 - m2) / sqrt(v1/n1 + v2/n2) AS t,
        (v1/n1 + v2/n2)^2 / ((v1/n1)^2/(n1-1) + (v2/n2)^2/(n2-1)) AS df FROM t_two""",
    "mann_whitney": """SELECT u, (greatest(u, n1*n2 - u) - n1*n2/2 - 0.5) / sqrt(n1*n2/12 * (n1+n2+1 - ties/((n1+n2)*(n1+n2-1)))) AS z
        FROM (SELECT sum(CASE WHEN is_late = 0 THEN ry END) - n1*(n1+1)/2 AS u, n1, n2, ties FROM t_ranked,
            (SELECT CAST(sum(1 - is_late) AS DOUBLE) AS n1, CAST(sum(is_late) AS DOUBLE) AS n2 FROM t_rows),
            (SELECT sum(t*t*t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM t_rows GROUP BY review_score))
            GROUP BY n1, n2, ties)""",
    "anova": """SELECT (b / (k-1)) / (w / (total-k)) AS f, k - 1 AS df1, CAST(total - k AS BIGINT) AS df2, b / (b + w) AS eta
        FROM (SELECT count(*) AS k, sum(n) AS total, sum(n*(mean - grand)^2) AS b, sum((n-1)*sd*sd) AS w
              FROM t_groups, (SELECT sum(n*mean)/sum(n) AS grand FROM t_groups))""",
    "kruskal": """SELECT (12/(n*(n+1))*q - 3*(n+1)) / (1 - ties/(n*n*n - n)) AS h, k - 1 AS df
        FROM (SELECT count(*) AS k, CAST(sum(c) AS DOUBLE) AS n, sum(rs*rs/c) AS q
              FROM (SELECT customer_state, count(*) AS c, sum(rk) AS rs FROM t_kw GROUP BY 1)),
             (SELECT sum(t*t*t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM t_kw GROUP BY rk))""",
}
P = {
    **dict.fromkeys(("pearson", "spearman"), p_t("(x * sqrt((n - 2) / (1 - x * x)))", "(n - 2)")),
    "welch_t": p_t("t", "df"), "mann_whitney": p_normal("z"), "anova": p_f("f", "df1", "df2"), "kruskal": p_chi2("h", "df"),
}
for _name in ("pearson", "spearman"):
    SQL[f"{_name}_delay_review"] = with_p(f'n, {r("x")} AS r, {_strength("x")}', INNER[_name], P[_name])
SQL["regression_line"] = f"""SELECT {r("regr_slope(review_score, delivery_delay_days)")} AS slope,
    {r("regr_intercept(review_score, delivery_delay_days)")} AS intercept FROM t_rows"""
SQL["late_group_stats"] = f"SELECT is_late, n, {r('mean')} AS mean, {r('sd')} AS sd, {r('median')} AS median FROM t_late"
SQL["welch_t"] = with_p(f'{r("t")} AS t, {r("df")} AS df', INNER["welch_t"], P["welch_t"])
_D = "(m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2))"
SQL["cohens_d"] = f"""SELECT {r(_D)} AS d, CASE WHEN abs({_D}) < 0.2 THEN 'negligible' WHEN abs({_D}) < 0.5 THEN 'small'
    WHEN abs({_D}) < 0.8 THEN 'medium' ELSE 'large' END AS band FROM t_two"""
SQL["mean_diff_ci"] = " UNION ALL ".join(
    f"SELECT '{name}' AS quantity, {r(v)} AS value, {r(se)} AS se, {r(f'{v} - 1.96*{se}')} AS ci_low, "
    f"{r(f'{v} + 1.96*{se}')} AS ci_high FROM t_two"
    for name, v, se in (
        ("difference", "(m1 - m2)", "sqrt(v1/n1 + v2/n2)"),
        ("on_time", "m1", "sqrt(v1/n1)"), ("late", "m2", "sqrt(v2/n2)"))
)
SQL["mann_whitney"] = with_p(f'{r("u")} AS u, {r("z")} AS z', INNER["mann_whitney"], P["mann_whitney"])
SQL["anova_groups"] = f"""SELECT customer_state, n, {r("mean")} AS mean, {r("sd")} AS sd, {r("median")} AS median
    FROM t_groups"""
SQL["anova_state"] = with_p(
    f"""{r("f", 4)} AS f, df1, df2, {r("eta")} AS eta_squared,
    CASE WHEN eta < 0.06 THEN 'small' WHEN eta < 0.14 THEN 'medium' ELSE 'large' END AS band""",
    INNER["anova"], P["anova"],
)
SQL["kruskal_state"] = with_p(f'{r("h", 4)} AS h, df', INNER["kruskal"], P["kruskal"])
SQL["hypothesis_summary"] = " UNION ALL ".join(
    f"""SELECT '{test}' AS test, {r(x, 4)} AS statistic, CAST({d1} AS DOUBLE) AS df1, CAST({d2} AS DOUBLE) AS df2,
    {r("p")} AS p, p < 0.05 AS significant, p < 0.01 AS significant_01 FROM (SELECT *, {P[test]} AS p FROM ({INNER[test]}))"""
    for test, x, d1, d2 in (
        ("pearson", "x", "n - 2", "NULL"), ("spearman", "x", "n - 2", "NULL"), ("welch_t", "t", r("df"), "NULL"),
        ("mann_whitney", "u", "NULL", "NULL"), ("anova", "f", "df1", "df2"), ("kruskal", "h", "df", "NULL"))
)
SQL["scatter_sample"] = """SELECT delivery_delay_days, review_score FROM t_rows
    ORDER BY CAST('0x' || substr(md5(order_id || '|' || order_item_id || '|42'), 1, 15) AS BIGINT), order_id, order_item_id
    LIMIT 5000"""
SQL["state_mean_ci"] = f"""SELECT customer_state, n, {r("mean")} AS mean, {r("sd")} AS sd, {r("median")} AS median,
    {r("sd/sqrt(n)")} AS se, {r("1.96*sd/sqrt(n)")} AS ci FROM t_groups"""
_CLASS = case_bucket(
    "delivery_delay_days", [-7, 0, 7, 14],
    ["'7+ early'", "'On-time'", "'1-7d late'", "'7-14d late'", "'14+ late'"],
)
SQL["box_by_delay"] = box(f"SELECT review_score, {_CLASS} AS k FROM t_rows", "k", "review_score")
SQL["box_by_state"] = box(
    "SELECT delivery_days, customer_state AS k FROM t_rows WHERE customer_state IN (SELECT customer_state FROM t_top)",
    "k", "delivery_days",
)

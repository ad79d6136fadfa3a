"""Yearly base, joins, ratings and indicator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import shapes as S
from queries.clean import text_orders
from queries.core import Tables, cte, query, sql_exact_mean, sql_exact_sum, sql_half_away, sql_half_even, sql_list
from riskspark import params as P
from riskspark.functions import curves as C
from riskspark.functions import dates as D
from riskspark.operators import accounts as ACC
from riskspark.operators import annual as A
from riskspark.operators import lookup, reports
from riskspark.operators.asof import asof_attach_sliced, attach_rating
from riskspark.plans import base as B
from riskspark.plans import postprocess as PP
from riskspark.plans import staging
from riskspark.sinks.tables import HISTORY_TYPE

START, END = S.WINDOW.start_year, S.WINDOW.end_year
AS_OF_SQL = f"DATE '{S.AS_OF}'"

# --- pivots ------------------------------------------------------------------------------


def sql_rule(rule) -> str:
    annex, codes, column_pattern, name_pattern = rule
    parts = [f"account_code IN ({sql_list(codes)})", f"annex LIKE '{annex}%'"]
    if column_pattern:
        parts.append(f"regexp_matches(lower(column_label), '{column_pattern}')")
    if name_pattern:
        parts.append(f"regexp_matches(lower(account_name), '{name_pattern}')")
    return " AND ".join(parts)


def sql_pivot(rules) -> str:
    return ",\n  ".join(f"MAX(CASE WHEN {sql_rule(rule)} THEN value END) AS {name}" for name, rule in rules.items())


cte("x_budget_wide", f"""
SELECT r.entity_id, r.year, l.period AS budget_period,
  {sql_pivot(P.BUDGET_RULES)}
FROM x_budget_staged r
JOIN (SELECT entity_id, year, max(period) AS period FROM x_budget_staged GROUP BY entity_id, year) l
  ON r.entity_id = l.entity_id AND r.year = l.year AND r.period = l.period
GROUP BY r.entity_id, r.year, l.period
""")
cte("x_regime", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, year ORDER BY CASE regime WHEN 'Q' THEN 1 WHEN 'S' THEN 2 ELSE 3 END)
              AS priority
  FROM (SELECT entity_id, year, regime, max(period) AS period FROM x_fiscal_staged WHERE annex = '{P.FISCAL_ANNEX}'
        GROUP BY entity_id, year, regime)) WHERE priority = 1
""")
cte("x_fiscal_wide", f"""
SELECT *, coalesce(cash_after_iv, cash_after_iii) AS cash_after_total,
       coalesce(cash_before_iv, cash_before_iii) AS cash_before_total
FROM (
SELECT r.entity_id, r.year, p.regime AS fiscal_regime, p.period AS fiscal_period,
  {sql_pivot(P.FISCAL_RULES)}
FROM x_fiscal_staged r
JOIN x_regime p ON r.entity_id = p.entity_id AND r.year = p.year AND r.regime = p.regime AND r.period = p.period
WHERE r.annex LIKE '{P.FISCAL_ANNEX}%'
GROUP BY r.entity_id, r.year, p.regime, p.period)
""")
cte("x_grid", """
SELECT d.entity_id, y.year FROM x_dim d
JOIN (SELECT DISTINCT state, year FROM x_budget_lines WHERE account_code IS NOT NULL AND value IS NOT NULL) y
  ON d.state = y.state
""")
BUDGET_MEASURES = list(P.BUDGET_RULES)
FISCAL_MEASURES = ["cash_after_total", "cash_after_pension", "cash_before_total", "cash_before_pension"]
cte("x_base", f"""
SELECT k.entity_id, k.year, k.in_grid, d.state, d.name, d.population, b.entity_id IS NOT NULL AS has_budget,
       f.entity_id IS NOT NULL AS has_fiscal, b.budget_period, f.fiscal_regime, f.fiscal_period,
       {", ".join("b." + m for m in BUDGET_MEASURES)}, {", ".join("f." + m for m in FISCAL_MEASURES)}
FROM (SELECT entity_id, year, bool_or(in_grid) AS in_grid FROM (
        SELECT entity_id, year, TRUE AS in_grid FROM x_grid
        UNION ALL SELECT entity_id, year, FALSE FROM x_budget_wide
        UNION ALL SELECT entity_id, year, FALSE FROM x_fiscal_wide) GROUP BY entity_id, year) k
LEFT JOIN x_dim d ON d.entity_id = k.entity_id
LEFT JOIN x_budget_wide b ON b.entity_id = k.entity_id AND b.year = k.year
LEFT JOIN x_fiscal_wide f ON f.entity_id = k.entity_id AND f.year = k.year
""")

KEYS = "entity_id:l year:l"
BUDGET_SPEC = " ".join(f"{m}:d" for m in BUDGET_MEASURES)
FISCAL_SPEC = " ".join(f"{m}:d" for m in FISCAL_MEASURES)


@query("pivot_accounts", f"{KEYS} budget_period:l {BUDGET_SPEC}", source="x_budget_wide")
def pivot_accounts(t: Tables) -> DataFrame:
    return ACC.budget_pivot(S.budget_lines(t))


@query("pivot_fiscal", f"{KEYS} fiscal_regime:s fiscal_period:l {FISCAL_SPEC}", source="x_fiscal_wide")
def pivot_fiscal(t: Tables) -> DataFrame:
    return ACC.fiscal_pivot(S.fiscal_lines(t))


@query(
    "latest_period",
    "entity_id:l year:l period:l annex:s account_code:s column_label:s value:d",
    """SELECT r.* FROM x_budget_lines r
       JOIN (SELECT entity_id, year, max(period) AS period FROM x_budget_lines GROUP BY entity_id, year) l
         ON r.entity_id = l.entity_id AND r.year = l.year AND r.period = l.period""",
)
def latest_period(t: Tables) -> DataFrame:
    return ACC.latest_period_rows(S.budget_lines(t), ["entity_id", "year"])


@query("priority_regime", f"{KEYS} regime:s period:l", source="x_regime")
def priority_regime(t: Tables) -> DataFrame:
    return ACC.priority_regime(S.fiscal_lines(t), ["entity_id", "year"])


@query("entity_year_grid", KEYS, source="x_grid")
def entity_year_grid(t: Tables) -> DataFrame:
    return ACC.entity_year_grid(S.dim(t), S.budget_lines(t))


@query(
    "entity_year_grid_all",
    KEYS,
    """SELECT d.entity_id, y.year FROM x_dim d CROSS JOIN (
         SELECT DISTINCT year FROM x_budget_lines WHERE account_code IS NOT NULL AND value IS NOT NULL) y""",
)
def entity_year_grid_all(t: Tables) -> DataFrame:
    return ACC.entity_year_grid(S.dim(t), S.budget_lines(t), by_state=False)


@query("entity_year_union", f"{KEYS} in_grid:b has_budget:b has_fiscal:b state:s name:s population:l", source="x_base")
def entity_year_union(t: Tables) -> DataFrame:
    return B.entity_year_union(S.dim(t), S.budget_lines(t), S.fiscal_lines(t))


def base(t: Tables) -> DataFrame:
    return t.shared("base", lambda t: B.base_annual(S.dim(t), S.budget_lines(t), S.fiscal_lines(t)))


@query(
    "base_annual",
    f"{KEYS} state:s name:s population:l in_grid:b has_budget:b has_fiscal:b budget_period:l fiscal_regime:s"
    f" fiscal_period:l {BUDGET_SPEC} {FISCAL_SPEC}",
    source="x_base",
)
def base_annual(t: Tables) -> DataFrame:
    return base(t)


@query(
    "outer_parts",
    f"{KEYS} {BUDGET_SPEC} {FISCAL_SPEC}",
    f"""SELECT coalesce(b.entity_id, f.entity_id) AS entity_id, coalesce(b.year, f.year) AS year,
              {", ".join("b." + m for m in BUDGET_MEASURES)}, {", ".join("f." + m for m in FISCAL_MEASURES)}
       FROM x_budget_wide b FULL JOIN x_fiscal_wide f ON b.entity_id = f.entity_id AND b.year = f.year""",
)
def outer_parts(t: Tables) -> DataFrame:
    parts = [ACC.budget_pivot(S.budget_lines(t)), ACC.fiscal_pivot(S.fiscal_lines(t))]
    return ACC.merge_on_key(["entity_id", "year"], parts, F.max)


# --- yearly indicators -------------------------------------------------------------------

NET = ("coalesce(cash_after_total - coalesce(cash_after_pension, 0e0),"
       " cash_before_total - coalesce(cash_before_pension, 0e0))")  # fmt: skip


def sql_percent(top: str) -> str:
    return f"CASE WHEN revenue_realized > 0 THEN {sql_half_away(f'(({top}) / revenue_realized * 100e0)', 2)} END"


cte("x_indicators", f"""
SELECT *, revenue_planned IS NOT NULL AS delivered,
  CASE WHEN revenue_planned > 0 THEN {sql_half_away("(revenue_realized / revenue_planned * 100e0)", 2)} END AS budget_exec,
  {sql_percent("unprocessed_arrears")} AS unprocessed_pct, {sql_percent("processed_arrears")} AS arrears_pct,
  {sql_percent("expense_settled - revenue_realized")} AS deficit_pct,
  CASE WHEN revenue_realized > 0 THEN {sql_half_away(f"({NET} / revenue_realized)", 6)} END AS liquidity,
  CASE WHEN revenue_realized > 0 THEN {sql_half_away(NET, 2)} END AS liquidity_gross,
  coalesce(revenue_realized > 0, FALSE) AND cash_after_total IS NULL AND cash_before_total IS NOT NULL AS liquidity_partial
FROM x_base
WHERE in_grid AND NOT (revenue_planned IS NULL AND revenue_realized IS NULL AND expense_settled IS NULL
  AND unprocessed_arrears IS NULL AND processed_arrears IS NULL AND cash_after_total IS NULL AND cash_before_total IS NULL)
""")


def indicators(t: Tables) -> DataFrame:
    return t.shared("indicators", lambda t: A.annual_indicators(base(t)))


@query(
    "annual_indicators",
    f"{KEYS} state:s name:s population:l {BUDGET_SPEC} fiscal_regime:s fiscal_period:l delivered:b budget_exec:d"
    " unprocessed_pct:d arrears_pct:d deficit_pct:d liquidity:d liquidity_gross:d liquidity_partial:b",
    source="x_indicators",
)
def annual_indicators(t: Tables) -> DataFrame:
    return indicators(t)


# --- ratings -----------------------------------------------------------------------------

cte("x_autonomy", f"""
SELECT entity_id, year, population, tax_revenue, current_revenue,
  CASE WHEN current_revenue > 0 THEN {sql_half_away("(tax_revenue / current_revenue)", 6)} END AS autonomy
FROM x_accounts, (SELECT least(coalesce(max(year), {END - 2}), {END - 2}) AS newest FROM x_accounts)
WHERE year BETWEEN newest - 4 AND newest
""")
cte("x_targets", "SELECT entity_id, year FROM x_base UNION SELECT entity_id, year FROM x_autonomy")
cte("x_resolved", """
SELECT entity_id, year, rating_year, coalesce(status, 'SEM_ICF') AS rating_status, coalesce(grade, 'SEM_ICF') AS rating_grade,
       coalesce(factor, 0.8e0) AS rating_factor, rating_year IS NULL AS rating_missing,
       rating_year IS NOT NULL AND rating_year < year AS rating_stale,
       coalesce(status = 'PREVIO_OFICIAL', FALSE) AS rating_preliminary
FROM (
  SELECT t.entity_id, t.year, r.year AS rating_year, r.status, r.grade, r.factor,
         row_number() OVER (PARTITION BY t.entity_id, t.year ORDER BY r.year DESC NULLS LAST) AS rn
  FROM x_targets t LEFT JOIN x_ratings r ON r.entity_id = t.entity_id AND r.year <= t.year) WHERE rn = 1
""")
RATING_SPEC = ("rating_year:l rating_status:s rating_grade:s rating_factor:d rating_missing:b rating_stale:b"
               " rating_preliminary:b")  # fmt: skip


@query(
    "autonomy_base",
    f"{KEYS} population:l tax_revenue:d current_revenue:d autonomy:d",
    source="x_autonomy",
)
def autonomy_base(t: Tables) -> DataFrame:
    return A.autonomy_base(S.accounts(t), S.AS_OF)


def target_frame(t: Tables) -> DataFrame:
    years = base(t).select("entity_id", "year")
    return years.union(A.autonomy_base(S.accounts(t), S.AS_OF).select("entity_id", "year")).distinct()


@query("target_years", KEYS, source="x_targets")
def target_years(t: Tables) -> DataFrame:
    return target_frame(t)


@query(
    "asof_sliced",
    "o_orderkey:l entity_id:l day:dt last_price:d last_order:l",
    """SELECT l.o_orderkey, l.entity_id, l.day, r.last_price, r.last_order
       FROM x_owned l ASOF LEFT JOIN (
         SELECT entity_id, day, price AS last_price, o_orderkey AS last_order FROM (
           SELECT *, row_number() OVER (PARTITION BY entity_id, day ORDER BY price DESC, o_orderkey DESC) AS place
           FROM x_owned WHERE status_code = 'F') WHERE place = 1) r
       ON l.entity_id = r.entity_id AND l.day >= r.day""",
)
def asof_sliced(t: Tables) -> DataFrame:
    """Every order with the newest finished one up to its day."""
    rows = S.owned_orders(t)
    finished = rows.filter("status_code = 'F'").select(
        "entity_id", "day", F.col("price").alias("last_price"), F.col("o_orderkey").alias("last_order")
    )
    left = rows.select("o_orderkey", "entity_id", "day")
    return asof_attach_sliced(left, finished, ["entity_id"], "day", ["last_price", "last_order"], lambda day: F.trunc(day, "quarter"))


@query("asof_rating", f"{KEYS} {RATING_SPEC}", source="x_resolved")
def asof_rating(t: Tables) -> DataFrame:
    return attach_rating(target_frame(t), S.ratings(t))


@query(
    "rating_union",
    "state:s entity_code:s year:l status:s percent:d",
    """SELECT state, lpad(CAST(entity_id AS VARCHAR), 7, '0') AS entity_code, year, status, percent FROM (
         SELECT *, row_number() OVER (PARTITION BY state, entity_id, year ORDER BY
           CASE status WHEN 'FINAL' THEN 0 ELSE 1 END, percent DESC NULLS LAST, grade DESC NULLS LAST) AS rn
         FROM x_raw_ratings WHERE status IN ('FINAL', 'PREVIO_OFICIAL')) WHERE rn = 1""",
)
def rating_union(t: Tables) -> DataFrame:
    rows = S.raw_ratings(t).select(
        F.upper(F.trim("state")).alias("state"),
        F.lpad("entity_code", 7, "0").alias("entity_code"),
        F.col("year").cast("bigint").alias("year"),
        F.col("edition").cast("bigint").alias("edition"),
        "status",
        F.upper(F.trim("grade")).alias("grade"),
        "percent",
    )
    final = rows.filter(F.col("status") == P.STATUS_FINAL)
    return staging.union_ratings(final, rows.filter(F.col("status") == P.STATUS_PRELIMINARY))


def sql_levels(column: str, prefix: str = "") -> str:
    quartiles = ", ".join(
        f"{sql_half_even(f'quantile_cont({column}, {q})', 4)} AS {prefix}{name}"
        for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    )
    return (f"{sql_half_even(sql_exact_mean(column), 4)} AS {prefix}mean, {sql_half_even(f'stddev_samp({column})', 4)}"
            f" AS {prefix}std, min({column}) AS {prefix}min, {quartiles}, max({column}) AS {prefix}max")  # fmt: skip


@query(
    "latest_year_profile",
    "year:l grade:s n_rows:l percent_mean:d percent_std:d percent_min:d percent_q25:d percent_median:d percent_q75:d"
    " percent_max:d",
    f"""SELECT year, grade, count(*) AS n_rows, {sql_levels("percent", "percent_")}
       FROM x_ratings WHERE year = (SELECT max(year) FROM x_ratings) GROUP BY year, grade""",
)
def latest_year_profile(t: Tables) -> DataFrame:
    return reports.latest_year_profile(S.ratings(t))


@query(
    "percent_describe",
    "n_values:l mean:d std:d min:d q25:d median:d q75:d max:d",
    f"""SELECT count(percent) AS n_values, {sql_levels("percent")}
       FROM x_ratings WHERE year = (SELECT max(year) FROM x_ratings)""",
)
def percent_describe(t: Tables) -> DataFrame:
    return reports.describe(reports.newest_year(S.ratings(t)), "percent", 4)


# --- per-entity aggregates ---------------------------------------------------------------

cte("x_rated", f"""
SELECT b.*, {", ".join("r." + c for c in ["rating_year", "rating_status", "rating_grade", "rating_factor", "rating_missing",
                                          "rating_stale", "rating_preliminary"])},
  b.revenue_planned IS NOT NULL AS delivered,
  CASE WHEN revenue_planned > 0 THEN {sql_half_away("(revenue_realized / revenue_planned * 100e0)", 6)} END AS exec6,
  CASE WHEN revenue_realized > 0 THEN processed_arrears / revenue_realized * 100e0 END AS arrears_raw
FROM x_base b JOIN x_resolved r ON r.entity_id = b.entity_id AND r.year = b.year
""")


def rated(t: Tables) -> DataFrame:
    return t.shared("rated", lambda t: PP.rated_base(base(t), S.ratings(t)))


@query(
    "coverage_count",
    "entity_id:l years_delivered:l coverage:d",
    f"""SELECT d.entity_id, coalesce(c.n, 0) AS years_delivered, least(coalesce(c.n, 0) / {END - START + 1}e0, 1e0) AS coverage
       FROM (SELECT DISTINCT entity_id FROM x_dim) d
       LEFT JOIN (SELECT entity_id, count(*) FILTER (WHERE revenue_planned IS NOT NULL) AS n FROM x_base
                  WHERE has_budget AND year BETWEEN {START} AND {END} GROUP BY entity_id) c ON c.entity_id = d.entity_id""",
)
def coverage_count(t: Tables) -> DataFrame:
    return A.spine_counts(S.dim(t).select("entity_id").distinct(), base(t), START, END)


cte("x_chronic", f"""
SELECT entity_id, count(*) FILTER (WHERE delivered AND arrears_raw > 3e0) AS chronic_years,
  {sql_half_away("arg_max(arrears_raw, year) FILTER (WHERE delivered AND arrears_raw IS NOT NULL)", 2)} AS arrears_pct_latest
FROM x_rated WHERE has_budget AND year BETWEEN {START} AND {END} GROUP BY entity_id
""")


@query(
    "chronic_years",
    "entity_id:l chronic_years:l arrears_pct_latest:d",
    """SELECT d.entity_id, coalesce(c.chronic_years, 0) AS chronic_years, c.arrears_pct_latest
       FROM x_dim d LEFT JOIN x_chronic c ON c.entity_id = d.entity_id""",
)
def chronic_years(t: Tables) -> DataFrame:
    rows = base(t).filter(F.col("has_budget") & F.col("year").between(START, END))
    counts = rows.groupBy("entity_id").agg(*A.chronic_aggs(F.lit(True)))
    return lookup.hub_join(S.dim(t).select("entity_id"), [counts], "entity_id", {"chronic_years": 0})


@query(
    "history_json",
    "entity_id:l year:l arrears_pct:d processed_arrears:d revenue_realized:d chronic:b position:l",
    f"""SELECT entity_id, year, {sql_half_away("arrears_raw", 2)} AS arrears_pct,
              {sql_half_away("processed_arrears", 2)} AS processed_arrears,
              {sql_half_away("revenue_realized", 2)} AS revenue_realized, arrears_raw > 3e0 AS chronic,
              row_number() OVER (PARTITION BY entity_id ORDER BY year) - 1 AS position
       FROM x_rated WHERE has_budget AND delivered AND arrears_raw IS NOT NULL AND year BETWEEN {START} AND {END}""",
)
def history_json(t: Tables) -> DataFrame:
    """The JSON history is written, parsed back and unfolded, so order and content are both checked."""
    rows = base(t).filter(F.col("has_budget") & F.col("year").between(START, END))
    history = rows.groupBy("entity_id").agg(*A.chronic_aggs(F.lit(True)))
    text = history.select("entity_id", F.to_json("arrears_history", {"ignoreNullFields": "false"}).alias("json"))
    parsed = text.select("entity_id", F.posexplode(F.from_json("json", HISTORY_TYPE)).alias("position", "h"))
    return parsed.select("entity_id", "position", "h.*")


WEIGHT_SQL = "CASE year " + " ".join(
    f"WHEN {END - 1 - i} THEN {w}e0" for i, w in enumerate(P.RECENCY_WEIGHTS) if END - 1 - i >= START
) + " END"
ANY_FLAGS = ["preliminary", "stale", "missing"]


def sql_any_flags(prefix: str, condition: str) -> str:
    return ", ".join(f"bool_or(rating_{f}) FILTER (WHERE {condition}) AS {prefix}_{f}" for f in ANY_FLAGS)


cte("x_recency", f"""
SELECT entity_id,
  {sql_half_even(f"(coalesce({sql_exact_sum('w * exec6', 10)}, 0e0) / {sql_exact_sum('w', 10)})", 6)} AS budget_exec,
  {sql_half_even(f"({sql_exact_sum('w * rating_factor', 10)} / {sql_exact_sum('w', 10)})", 6)} AS budget_factor,
  {sql_any_flags("budget", "TRUE")}
FROM (SELECT *, {WEIGHT_SQL} AS w FROM x_rated WHERE has_budget AND delivered AND year BETWEEN {START} AND {END})
WHERE w IS NOT NULL GROUP BY entity_id
""")


def recency_weight_column() -> F.Column:
    in_years = F.col("has_budget") & F.col("year").between(START, END)
    return F.when(in_years & A.delivered(), A.recency_weight(F.col("year"), S.WINDOW.last_closed_year, START))


@query(
    "weighted_recency",
    "entity_id:l budget_exec:d budget_factor:d budget_preliminary:b budget_stale:b budget_missing:b",
    source="x_recency",
)
def weighted_recency(t: Tables) -> DataFrame:
    weight = recency_weight_column()
    rows = rated(t).filter(weight.isNotNull())
    return rows.groupBy("entity_id").agg(*A.weighted_recency_aggs(F.col("budget_exec"), weight, "budget_exec"))


@query(
    "weighted_recency_present",
    "entity_id:l budget_exec:d",
    f"""SELECT entity_id, {sql_half_even(f"({sql_exact_sum('w * budget_exec', 10)} / {sql_exact_sum('w', 10)})", 4)}
              AS budget_exec
       FROM (SELECT *, {WEIGHT_SQL} AS w FROM x_indicators) WHERE delivered AND w IS NOT NULL AND budget_exec IS NOT NULL
       GROUP BY entity_id""",
)
def weighted_recency_present(t: Tables) -> DataFrame:
    weight = F.when(F.col("delivered"), A.recency_weight(F.col("year"), S.WINDOW.last_closed_year, START))
    rows = indicators(t).filter(weight.isNotNull() & F.col("budget_exec").isNotNull())
    aggs = A.weighted_recency_aggs(F.col("budget_exec"), weight, "budget_exec", 4, True, False)
    return rows.groupBy("entity_id").agg(*aggs)


MONTH_SQL = ("CASE fiscal_regime WHEN 'Q' THEN CASE fiscal_period WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 END"
             " WHEN 'S' THEN CASE fiscal_period WHEN 1 THEN 6 WHEN 2 THEN 12 END END")  # fmt: skip
DELAY_SQL = (f"CASE WHEN ({MONTH_SQL}) IS NULL THEN 999 ELSE greatest(date_diff('day', CAST(make_date(CAST(year AS INTEGER), CAST({MONTH_SQL} AS INTEGER), 1)"
             f" + INTERVAL 2 MONTH AS DATE), {AS_OF_SQL}), 0) END")  # fmt: skip
LATE_SQL = "CASE WHEN coalesce(population, 0) > 50000 THEN 90 ELSE 210 END"


def sql_decay(days: str) -> str:
    slow = sql_half_even(f"greatest(1e0 - CAST(({days}) - ({LATE_SQL}) AS DOUBLE) / 365e0, 0e0)", 4)
    return f"CASE WHEN ({days}) <= ({LATE_SQL}) THEN 1e0 ELSE {slow} END"


cte("x_pick", f"""
SELECT *, {sql_decay("delay_days")} AS decay, delay_days > {LATE_SQL} AS liquidity_stale FROM (
  SELECT *, {DELAY_SQL} AS delay_days, row_number() OVER (PARTITION BY entity_id ORDER BY year DESC, fiscal_period DESC,
           CASE fiscal_regime WHEN 'Q' THEN 0 ELSE 1 END) AS rn
  FROM (SELECT *, {sql_half_even(f"({NET} / revenue_realized)", 6)} AS liquidity,
               cash_after_total IS NULL AS liquidity_partial
        FROM x_rated WHERE has_fiscal AND year BETWEEN {START} AND {END} AND revenue_realized > 0
          AND (cash_after_total IS NOT NULL OR cash_before_total IS NOT NULL))) WHERE rn = 1
""")


@query(
    "liquidity_pick",
    "entity_id:l liquidity_year:l liquidity:d liquidity_partial:b liquidity_suspect:b delay_days:l decay:d"
    " liquidity_stale:b liquidity_rating_year:l liquidity_rating_status:s liquidity_rating_grade:s liquidity_factor:d"
    " liquidity_rating_preliminary:b liquidity_rating_stale:b liquidity_rating_missing:b",
    f"""SELECT e.entity_id, p.year AS liquidity_year, p.liquidity, coalesce(p.liquidity_partial, FALSE) AS liquidity_partial,
              coalesce(p.liquidity < -0.5e0, FALSE) AS liquidity_suspect, p.delay_days, p.decay,
              coalesce(p.liquidity_stale, FALSE) AS liquidity_stale, p.rating_year AS liquidity_rating_year,
              coalesce(p.rating_status, 'SEM_ICF') AS liquidity_rating_status,
              coalesce(p.rating_grade, 'SEM_ICF') AS liquidity_rating_grade,
              coalesce(p.rating_factor, 0.8e0) AS liquidity_factor,
              coalesce(p.rating_preliminary, FALSE) AS liquidity_rating_preliminary,
              coalesce(p.rating_stale, FALSE) AS liquidity_rating_stale,
              coalesce(p.rating_missing, TRUE) AS liquidity_rating_missing
       FROM (SELECT DISTINCT entity_id FROM x_base WHERE has_fiscal AND year BETWEEN {START} AND {END}) e
       LEFT JOIN x_pick p ON p.entity_id = e.entity_id""",
)
def liquidity_pick(t: Tables) -> DataFrame:
    rows = rated(t).filter(F.col("has_fiscal") & F.col("year").between(START, END))
    picked = rows.groupBy("entity_id").agg(
        F.max("population").alias("population"),
        F.lit(True).alias("_has_fiscal"),
        *A.liquidity_pick_aggs(S.AS_OF, F.lit(True)),
    )
    return A.expand_liquidity_pick(picked)


cte("x_arrears_rating", f"""
SELECT entity_id, {sql_exact_mean("rating_factor", 10)} AS arrears_factor, {sql_any_flags("arrears", "TRUE")}
FROM x_rated WHERE in_grid AND delivered AND arrears_raw IS NOT NULL GROUP BY entity_id
UNION ALL
SELECT DISTINCT entity_id, 0.8e0, FALSE, FALSE, TRUE FROM x_rated g WHERE in_grid AND NOT EXISTS (
  SELECT 1 FROM x_rated v WHERE v.state = g.state AND v.in_grid AND v.delivered AND v.arrears_raw IS NOT NULL)
""")


@query(
    "arrears_rating",
    "entity_id:l arrears_factor:d arrears_preliminary:b arrears_stale:b arrears_missing:b",
    source="x_arrears_rating",
)
def arrears_rating(t: Tables) -> DataFrame:
    return PP.arrears_rating(rated(t))


CRITICAL_BY_STATE = {s: P.CRITICAL_AUTONOMY[r] for s, r in P.STATE_REGION.items()}


def sql_by_state(values: dict) -> str:
    return "CASE state " + " ".join(f"WHEN '{s}' THEN {v!r}e0" for s, v in sorted(values.items())) + " END"


cte("x_autonomy_profile", f"""
SELECT m.*, coalesce(m.autonomy_mean < {sql_by_state(CRITICAL_BY_STATE)}, FALSE) AS autonomy_critical FROM (
  SELECT a.entity_id, {sql_exact_mean("autonomy", 10)} AS autonomy_mean,
    {sql_half_even(sql_exact_mean("rating_factor", 10), 6)} AS autonomy_factor, {sql_any_flags("autonomy", "TRUE")}
  FROM x_autonomy a JOIN x_resolved r ON r.entity_id = a.entity_id AND r.year = a.year GROUP BY a.entity_id) m
JOIN x_dim d ON d.entity_id = m.entity_id
""")


@query(
    "mean_any",
    "entity_id:l autonomy_mean:d autonomy_factor:d autonomy_preliminary:b autonomy_stale:b autonomy_missing:b"
    " autonomy_critical:b",
    source="x_autonomy_profile",
)
def mean_any(t: Tables) -> DataFrame:
    return PP.autonomy_profile(S.accounts(t), S.ratings(t), S.dim(t), S.AS_OF)


cte("x_fallback", f"""
SELECT entity_id, {sql_exact_mean("cash_ratio", 10)} AS cash_ratio_mean, {sql_exact_mean("autonomy", 10)} AS autonomy_mean,
       count(*) FILTER (WHERE balance_available) AS balance_years, count(*) FILTER (WHERE revenue_available) AS revenue_years
FROM (
  SELECT a.entity_id, balance_available, revenue_available,
         CASE WHEN coalesce(current_revenue, fallback) > 0 THEN (financial_assets - financial_liabilities)
              / coalesce(current_revenue, fallback) END AS cash_ratio,
         CASE WHEN coalesce(current_revenue, fallback) > 0 THEN tax_revenue / coalesce(current_revenue, fallback) END AS autonomy
  FROM x_accounts a LEFT JOIN (SELECT entity_id, {sql_exact_mean("revenue_realized")} AS fallback FROM x_indicators
                               GROUP BY entity_id) f ON f.entity_id = a.entity_id)
GROUP BY entity_id
""")


@query(
    "fallback_ratio",
    "entity_id:l cash_ratio_mean:d autonomy_mean:d balance_years:l revenue_years:l",
    source="x_fallback",
)
def fallback_ratio(t: Tables) -> DataFrame:
    return A.fallback_ratios(S.accounts(t), indicators(t))


@query(
    "topk_ratio",
    "side:s entity_id:l cash_ratio_mean:d",
    """SELECT * FROM (SELECT 'top' AS side, entity_id, cash_ratio_mean FROM x_fallback WHERE cash_ratio_mean IS NOT NULL
                     ORDER BY cash_ratio_mean DESC, entity_id LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'bottom' AS side, entity_id, cash_ratio_mean FROM x_fallback
                     WHERE cash_ratio_mean IS NOT NULL ORDER BY cash_ratio_mean, entity_id LIMIT 5)""",
)
def topk_ratio(t: Tables) -> DataFrame:
    return reports.extreme_rows(A.fallback_ratios(S.accounts(t), indicators(t)), "cash_ratio_mean", 5)


@query(
    "ratio_levels",
    "n_insolvent:l n_slack:l n_critical:l n_good:l",
    """SELECT count(*) FILTER (WHERE cash_ratio_mean < 0) AS n_insolvent,
              count(*) FILTER (WHERE cash_ratio_mean > 0.10e0) AS n_slack,
              count(*) FILTER (WHERE autonomy_mean < 0.05e0) AS n_critical,
              count(*) FILTER (WHERE autonomy_mean > 0.20e0) AS n_good FROM x_fallback""",
)
def ratio_levels(t: Tables) -> DataFrame:
    ratios = A.fallback_ratios(S.accounts(t), indicators(t))
    return ratios.agg(
        F.count_if(F.col("cash_ratio_mean") < 0).alias("n_insolvent"),
        F.count_if(F.col("cash_ratio_mean") > 0.10).alias("n_slack"),
        F.count_if(F.col("autonomy_mean") < 0.05).alias("n_critical"),
        F.count_if(F.col("autonomy_mean") > 0.20).alias("n_good"),
    )


@query(
    "sort_name_year",
    "name:s year:l entity_id:l arrears_pct:d",
    "SELECT name, year, entity_id, arrears_pct FROM x_indicators ORDER BY name, year",
)
def sort_name_year(t: Tables) -> DataFrame:
    return indicators(t).orderBy("name", "year")


POST_SPEC = (
    "entity_id:l budget_exec:d budget_factor:d budget_preliminary:b budget_stale:b budget_missing:b liquidity_year:l"
    " liquidity:d liquidity_partial:b delay_days:l decay:d liquidity_suspect:b liquidity_stale:b liquidity_factor:d"
    " liquidity_rating_missing:b arrears_factor:d arrears_preliminary:b arrears_stale:b arrears_missing:b"
)
cte("x_postprocess", f"""
SELECT e.entity_id, r.budget_exec, r.budget_factor, r.budget_preliminary, r.budget_stale, r.budget_missing,
  p.year AS liquidity_year, p.liquidity, coalesce(p.liquidity_partial, FALSE) AS liquidity_partial, p.delay_days, p.decay,
  coalesce(p.liquidity < -0.5e0, FALSE) AS liquidity_suspect, coalesce(p.liquidity_stale, FALSE) AS liquidity_stale,
  coalesce(p.rating_factor, 0.8e0) AS liquidity_factor,
  CASE WHEN f.entity_id IS NOT NULL THEN coalesce(p.rating_missing, TRUE) END AS liquidity_rating_missing,
  a.arrears_factor, a.arrears_preliminary, a.arrears_stale, a.arrears_missing
FROM (SELECT DISTINCT entity_id FROM x_base) e
LEFT JOIN x_recency r ON r.entity_id = e.entity_id
LEFT JOIN x_pick p ON p.entity_id = e.entity_id
LEFT JOIN x_arrears_rating a ON a.entity_id = e.entity_id
LEFT JOIN (SELECT DISTINCT entity_id FROM x_base WHERE has_fiscal AND year BETWEEN {START} AND {END}) f
  ON f.entity_id = e.entity_id
WHERE r.entity_id IS NOT NULL OR f.entity_id IS NOT NULL OR a.entity_id IS NOT NULL
""")


@query("postprocess", POST_SPEC, source="x_postprocess")
def postprocess(t: Tables) -> DataFrame:
    return PP.postprocess(S.dim(t), S.budget_lines(t), S.fiscal_lines(t), S.ratings(t), S.WINDOW)


# --- first match, plans ------------------------------------------------------------------


@query(
    "first_match",
    "entity_id:l year:l account:s first_value:d last_value:d",
    """SELECT entity_id, year, account, max(CASE WHEN first_no = 1 THEN amount END) AS first_value,
              max(CASE WHEN last_no = 1 THEN amount END) AS last_value FROM (
         SELECT entity_id, year, lower(account_name) AS account, amount,
                row_number() OVER (PARTITION BY entity_id, year, lower(account_name)
                  ORDER BY column_label = 'Valor' DESC, column_label <> 'Valor' AND amount IS NULL, seq) AS first_no,
                row_number() OVER (PARTITION BY entity_id, year, lower(account_name) ORDER BY seq DESC) AS last_no FROM (
           SELECT w.entity_id, w.year, 'Conta ' || w.l_linestatus AS account_name,
                  CASE WHEN w.l_returnflag = 'R' THEN 'Valor' ELSE 'Outra' END AS column_label,
                  w.o_orderkey * 1000000000 + w.line * 100000000 + w.l_partkey * 1000 + w.l_suppkey AS seq,
                  CASE w.line WHEN 7 THEN 0e0 WHEN 6 THEN NULL ELSE w.l_extendedprice END AS amount
           FROM x_order_lines w))
       GROUP BY entity_id, year, account""",
)
def first_match(t: Tables) -> DataFrame:
    seq = F.col("o_orderkey") * 1_000_000_000 + F.col("line") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    text = F.when(F.col("line") == 7, " ").when(F.col("line") == 6, "x1").otherwise(F.col("l_extendedprice").cast("string"))
    lines = S.order_lines(t).select(
        "entity_id",
        "year",
        F.concat(F.lit(" Conta "), F.col("l_linestatus")).alias("account_name"),
        F.when(F.col("l_returnflag") == "R", " Valor").otherwise("Outra").alias("column_label"),
        seq.alias("seq"),
        text.alias("value"),
    )
    return ACC.first_match(lines, ["entity_id", "year"], "Valor")


cte("x_plan_lines", """
SELECT entity_id, year, period, population, regime,
       CASE WHEN l_returnflag = 'R' THEN 'RGF Simplificado' ELSE 'RGF' END AS kind
FROM (SELECT entity_id, year, population, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'Q' ELSE 'S' END AS regime,
        CAST(CASE WHEN l_linestatus = 'O' THEN ceil(month / 4e0) ELSE ceil(month / 6e0) END AS INTEGER) AS period
      FROM x_order_lines)
""")


def sql_plan_rank(plans) -> str:
    return "CASE " + " ".join(f"WHEN kind = '{k}' AND regime = '{r}' THEN {i}" for i, (k, r) in enumerate(plans)) + " END"


@query(
    "prefer_plan",
    "entity_id:l year:l kind:s regime:s period:l n_lines:l",
    f"""SELECT entity_id, year, kind, regime, period, n_lines FROM (
         SELECT *, row_number() OVER (PARTITION BY entity_id, year ORDER BY CASE WHEN population <= 50000
             THEN {sql_plan_rank(P.FISCAL_PLANS_SMALL)} ELSE {sql_plan_rank(P.FISCAL_PLANS_LARGE)} END, period DESC) AS rn
         FROM (SELECT entity_id, year, kind, regime, period, population, count(*) AS n_lines FROM x_plan_lines
               GROUP BY entity_id, year, kind, regime, period, population)) WHERE rn = 1""",
)
def prefer_plan(t: Tables) -> DataFrame:
    kind = F.when(F.col("annex").endswith("(Consolidado)"), "RGF Simplificado").otherwise("RGF")
    return reports.prefer_plan(S.fiscal_lines(t).withColumn("kind", kind))


# --- curves ------------------------------------------------------------------------------


@query(
    "curve_liquidity",
    "id:l points:d suspect:b",
    f"""SELECT id, CASE WHEN x IS NULL THEN NULL WHEN c >= 0.35e0 THEN 1e0
              WHEN c >= 0.10e0 THEN {sql_half_even("(0.60e0 + (c - 0.10e0) / 0.25e0 * 0.40e0)", 4)}
              WHEN c >= 0 THEN {sql_half_even("(0.35e0 + c / 0.10e0 * 0.25e0)", 4)}
              ELSE {sql_half_even("((c + 0.50e0) / 0.50e0 * 0.35e0)", 4)} END AS points, coalesce(x < -0.5e0, FALSE) AS suspect
       FROM (SELECT id, x, greatest(x, -0.5e0) AS c FROM (
         SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'
                THEN (o_totalprice - 250000e0) / 350000e0 END AS x FROM orders))""",
)
def curve_liquidity(t: Tables) -> DataFrame:
    blank = (F.col("status_code") == "P") & (F.col("priority") == 5)
    x = F.when(~blank, (F.col("price") - 250000.0) / 350000.0)
    return text_orders(t).select("id", C.liquidity_curve(x).alias("points"), C.liquidity_suspect(x).alias("suspect"))


@query(
    "curve_budget",
    "id:l points:d raw_points:d",
    f"""SELECT id, CASE WHEN x > 120 THEN 0.5e0 WHEN x > 105 THEN {sql_half_even("(1e0 - (x - 105e0) / 30e0)", 4)}
              WHEN x >= 90 THEN 1e0 WHEN x >= 70 THEN {sql_half_even("((x - 70e0) / 20e0)", 4)} ELSE 0e0 END AS points,
              CASE WHEN x > 120 THEN 0.5e0 WHEN x > 105 THEN 1e0 - (x - 105e0) / 30e0
              WHEN x >= 90 THEN 1e0 WHEN x >= 70 THEN (x - 70e0) / 20e0 ELSE 0e0 END AS raw_points
       FROM (SELECT o_orderkey AS id, o_totalprice / 3500e0 AS x FROM orders)""",
)
def curve_budget(t: Tables) -> DataFrame:
    x = F.col("price") / 3500.0
    return text_orders(t).select("id", C.budget_curve(x).alias("points"), C.budget_curve(x, None).alias("raw_points"))


@query(
    "curve_arrears",
    "entity_id:l years:l points:d",
    """SELECT entity_id, years, CASE years WHEN 0 THEN 1e0 WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.3e0
              WHEN 4 THEN 0.1e0 ELSE 0e0 END AS points
       FROM (SELECT entity_id, count(DISTINCT year) AS years FROM x_owned GROUP BY entity_id)""",
)
def curve_arrears(t: Tables) -> DataFrame:
    years = S.owned_orders(t).groupBy("entity_id").agg(F.count_distinct("year").alias("years"))
    return years.withColumn("points", C.arrears_curve(F.col("years")))


TIER_SQL = ("CASE WHEN population < 10000 THEN 'micro' WHEN population < 50000 THEN 'pequeno'"
            " WHEN population < 200000 THEN 'médio' ELSE 'grande' END")  # fmt: skip
MU_SQL = "CASE region " + " ".join(
    f"WHEN '{region}' THEN CASE tier " + " ".join(f"WHEN '{tier}' THEN {mu}e0" for tier, mu in by.items()) + " END"
    for region, by in P.SIGMOID_MIDPOINT.items()
) + " END"
K_SQL = "CASE tier " + " ".join(f"WHEN '{tier}' THEN {k}e0" for tier, k in P.SIGMOID_SLOPE.items()) + " END"
REGION_SQL = "CASE " + " ".join(f"WHEN state IN ({sql_list(s)}) THEN '{r}'" for r, s in P.REGIONS.items()) + " END"


def sql_sigmoid(x: str) -> str:
    return sql_half_even(f"(1e0 / (1e0 + exp(-({K_SQL}) * ({x} - ({MU_SQL})))))", 4)


@query(
    "curve_sigmoid",
    "id:l tier:s points:d",
    f"""SELECT id, tier, {sql_sigmoid("x")} AS points FROM (
          SELECT o_orderkey AS id, price / 5000000e0 AS x, {TIER_SQL} AS tier, {REGION_SQL} AS region FROM x_owned)""",
)
def curve_sigmoid(t: Tables) -> DataFrame:
    rows = lookup.with_state_params(S.owned_orders(t))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        C.size_tier(F.col("population")).alias("tier"),
        C.autonomy_sigmoid(F.col("price") / 5000000.0, F.col("population")).alias("points"),
    )


@query(
    "delay_decay",
    f"{KEYS} delay_days:l decay:d stale:b",
    f"""SELECT entity_id, year, delay_days, {sql_decay("delay_days")} AS decay, delay_days > {LATE_SQL} AS stale
       FROM (SELECT *, {DELAY_SQL} AS delay_days FROM x_base)""",
)
def delay_decay(t: Tables) -> DataFrame:
    days = D.report_delay_days(F.col("year"), F.col("fiscal_period"), F.col("fiscal_regime"), S.AS_OF)
    population = F.coalesce("population", F.lit(0))
    rows = base(t).withColumn("delay_days", days)
    return rows.withColumns(
        {
            "decay": D.delay_decay(F.col("delay_days"), population),
            "stale": F.col("delay_days") > D.delay_window(population),
        }
    )


# --- set operations ----------------------------------------------------------------------


@query(
    "coverage_gap",
    "entity_id:l",
    "SELECT entity_id FROM x_dim EXCEPT SELECT entity_id FROM x_indicators WHERE arrears_pct IS NOT NULL",
)
def coverage_gap(t: Tables) -> DataFrame:
    return lookup.coverage_gap(S.dim(t), indicators(t).filter("arrears_pct IS NOT NULL"))


@query(
    "entity_intersect",
    "entity_id:l year:l",
    """SELECT entity_id, year FROM x_indicators INTERSECT SELECT entity_id, year - 1 FROM x_indicators""",
)
def entity_intersect(t: Tables) -> DataFrame:
    """Entities present in a year and in the next, for all years."""
    rows = indicators(t)
    return rows.select("entity_id", "year").intersect(rows.select("entity_id", (F.col("year") - 1).alias("year")))

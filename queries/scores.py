"""Compliance flags, procurement, scoring and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import indicators as I
from queries import shapes as S
from queries.core import Tables, cte, query, sql_exact_mean, sql_exact_sum, sql_half_away, sql_half_even, sql_list
from riskspark import params as P
from riskspark.functions.numbers import half_even
from riskspark.functions.ratings import class_label, class_rank
from riskspark.operators import contracts as K
from riskspark.operators import flags as FL
from riskspark.operators.annual import fallback_ratios
from riskspark.plans import history, market, score

START, END = S.WINDOW.start_year, S.WINDOW.end_year

# --- compliance flags --------------------------------------------------------------------

REQUIREMENT_VALUES = ", ".join(
    f"('{col}', '{code}', '{text}', '{severity}', {i})" for i, (col, code, text, severity) in enumerate(P.REQUIREMENTS)
)
RANK_SQL = "CASE severity WHEN 'GRAVE' THEN 1 WHEN 'MODERADA' THEN 2 ELSE 3 END"
cte("x_pending", f"""
SELECT f.entity_id, r.code, r.label, r.severity, r.pos
FROM (SELECT entity_id, req, flag FROM x_flags UNPIVOT INCLUDE NULLS (flag FOR req IN ({", ".join(P.REQUIREMENT_COLUMNS)}))) f
JOIN (VALUES {REQUIREMENT_VALUES}) AS r(req, code, label, severity, pos) ON r.req = f.req
WHERE trim(coalesce(f.flag, '')) IN ('!', '')
""")
cte("x_flags_severity", f"""
SELECT s.entity_id, coalesce(n_severe, 0) AS n_severe, coalesce(n_moderate, 0) AS n_moderate, coalesce(n_light, 0) AS n_light,
  coalesce(pending_text, 'REGULAR') AS pending_text, coalesce(pending_json, '[]') AS pending_json,
  CASE WHEN coalesce(n_severe, 0) > 0 THEN 1e0
       ELSE least((coalesce(n_moderate, 0) * 2e0 + coalesce(n_light, 0)) / 20e0, 0.5e0) END AS compliance_risk
FROM x_flags s LEFT JOIN (
  SELECT entity_id, count(*) FILTER (WHERE severity = 'GRAVE') AS n_severe,
    count(*) FILTER (WHERE severity = 'MODERADA') AS n_moderate, count(*) FILTER (WHERE severity = 'LEVE') AS n_light,
    string_agg(label, ' | ' ORDER BY {RANK_SQL}, label) AS pending_text,
    '[' || string_agg('{{"code":"' || code || '","text":"' || label || '","severity":"' || severity || '"}}', ','
                      ORDER BY {RANK_SQL}, label) || ']' AS pending_json
  FROM x_pending GROUP BY entity_id) a ON a.entity_id = s.entity_id
""")


@query(
    "flags_severity",
    "entity_id:l n_severe:l n_moderate:l n_light:l pending_text:s pending_json:s compliance_risk:d",
    source="x_flags_severity",
)
def flags_severity(t: Tables) -> DataFrame:
    return FL.flags_severity(S.flags(t))


@query(
    "pending_flags_row",
    "entity_id:l blocked:b n_pending:l pending_text:s",
    """SELECT s.entity_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_pending, coalesce(txt, 'REGULAR') AS pending_text
       FROM x_flags s LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(label, ' | ' ORDER BY pos) AS txt
                                 FROM x_pending GROUP BY entity_id) a ON a.entity_id = s.entity_id""",
)
def pending_flags_row(t: Tables) -> DataFrame:
    return FL.pending_flags_row(S.flags(t))


@query(
    "flags_text_score",
    "entity_id:l compliance_risk:d",
    f"""SELECT entity_id, CASE WHEN n_severe > 0 THEN 1e0
              ELSE {sql_half_even("compliance_risk", 4)} END AS compliance_risk FROM x_flags_severity""",
)
def flags_text_score(t: Tables) -> DataFrame:
    rows = FL.pending_flags_row(S.flags(t))
    return rows.select("entity_id", FL.text_severity(F.col("pending_text")).alias("compliance_risk"))


# --- procurement -------------------------------------------------------------------------


def sql_market(as_of) -> str:
    def share(name: str) -> str:
        return f"{sql_half_away(f'(value_{name} / NULLIF(value_total, 0e0))', 6)} AS pct_{name}"

    def total(condition: str) -> str:
        return sql_exact_sum(f"(CASE WHEN {condition} THEN v END)")

    return f"""
SELECT *, {share("waiver")}, {share("no_contest")}, {share("direct")} FROM (
  SELECT entity_id, count(*) AS n_contracts, count(v) AS n_with_value, count(*) FILTER (WHERE v IS NULL) AS n_without_value,
    count(*) FILTER (WHERE awarded_value > 8e9) AS n_outliers, {sql_exact_sum("v")} AS value_total,
    count(*) FILTER (WHERE modality = 8) AS n_waiver, {total("modality = 8")} AS value_waiver,
    count(*) FILTER (WHERE modality = 9) AS n_no_contest, {total("modality = 9")} AS value_no_contest,
    count(*) FILTER (WHERE modality IN (8, 9)) AS n_direct, {total("modality IN (8, 9)")} AS value_direct,
    max(purchase_year) AS last_year
  FROM (SELECT *, CASE WHEN awarded_value <= 8e9 THEN awarded_value END AS v FROM x_contracts
        WHERE published >= CAST(DATE '{as_of}' - INTERVAL 6 MONTH AS DATE) AND entity_id IS NOT NULL)
  GROUP BY entity_id)
"""


cte("x_market", sql_market(S.CONTRACTS_AS_OF))
cte("x_market_score", sql_market(S.AS_OF))
MARKET_SPEC = (
    "entity_id:l n_contracts:l n_with_value:l n_without_value:l n_outliers:l value_total:d n_waiver:l value_waiver:d"
    " pct_waiver:d n_no_contest:l value_no_contest:d pct_no_contest:d n_direct:l value_direct:d pct_direct:d last_year:l"
)


@query("contracts_agg", MARKET_SPEC, source="x_market")
def contracts_agg(t: Tables) -> DataFrame:
    return K.contracts_agg(S.contracts(t), S.CONTRACTS_AS_OF)


@query(
    "contracts_mart",
    f"{MARKET_SPEC} state:s name:s population:l award_alert:b",
    """SELECT m.*, d.state, d.name, d.population, coalesce(m.pct_waiver, 0e0) > 0.30e0 AS award_alert
       FROM x_market m LEFT JOIN x_dim d ON d.entity_id = m.entity_id""",
)
def contracts_mart(t: Tables) -> DataFrame:
    return market.contracts_mart(S.contracts(t), S.dim(t), S.CONTRACTS_AS_OF)


cte("x_market12", f"""
SELECT *, coalesce(pct_waiver > 0.30e0, FALSE) AS award_alert FROM (
  SELECT *, {sql_half_even("(value_waiver / NULLIF(value_total, 0e0))", 4)} AS pct_waiver FROM (
    SELECT entity_id, count(contract_id) AS n_contracts, {sql_exact_sum("coalesce(awarded_value, 0e0)")} AS value_total,
      count(*) FILTER (WHERE modality IN (8, 9)) AS n_waiver,
      {sql_exact_sum("(CASE WHEN modality IN (8, 9) THEN coalesce(awarded_value, 0e0) ELSE 0e0 END)")} AS value_waiver,
      max(purchase_year) AS last_year
    FROM x_contracts WHERE published >= CAST(DATE '{S.CONTRACTS_AS_OF}' - INTERVAL 12 MONTH AS DATE)
      AND entity_id IS NOT NULL GROUP BY entity_id))
""")


@query(
    "contracts_agg_12m",
    "entity_id:l n_contracts:l value_total:d n_waiver:l value_waiver:d pct_waiver:d award_alert:b last_year:l",
    source="x_market12",
)
def contracts_agg_12m(t: Tables) -> DataFrame:
    return K.contracts_agg_12m(S.contracts(t), S.CONTRACTS_AS_OF)


@query(
    "pending_blocks",
    "block_key:s n_planned:l",
    """SELECT p.block_key, p.n_planned FROM (
         SELECT modality || '_' || strftime(published, '%Y-%m') AS block_key, count(*) AS n_planned
         FROM x_raw_contracts GROUP BY 1) p
       WHERE p.block_key NOT IN (SELECT modality || '_' || strftime(published, '%Y-%m') FROM x_raw_contracts
                                 WHERE no_data = 'False' AND published < DATE '2001-01-01')""",
)
def pending_blocks(t: Tables) -> DataFrame:
    raw = S.raw_contracts(t).select(
        F.col("modality").cast("double").cast("bigint").alias("modality"),
        F.to_date(F.substring("published", 1, 10)).alias("published"),
        "no_data",
    )
    keyed = raw.withColumn("block_key", K.block_key(F.col("modality"), F.col("published")))
    planned = keyed.groupBy("block_key").agg(F.count(F.lit(1)).alias("n_planned"))
    done = keyed.filter((F.col("no_data") == "False") & (F.col("published") < F.lit("2001-01-01").cast("date")))
    return K.pending_blocks(planned, done)


# --- score -------------------------------------------------------------------------------


def inputs(t: Tables) -> score.Inputs:
    return score.Inputs(
        S.dim(t), S.budget_lines(t), S.fiscal_lines(t), S.accounts(t), S.ratings(t), S.flags(t), S.contracts(t)
    )


def flag_columns(prefix: str, source: str) -> str:
    return ", ".join(f"coalesce({source}_{f}, FALSE) AS {prefix}_{f}" for f in I.ANY_FLAGS)


cte("x_dim_tier", f"SELECT *, {I.REGION_SQL} AS region, {I.TIER_SQL} AS tier FROM x_dim")
cte("x_hub", f"""
SELECT d.entity_id, d.state, d.name, d.population, d.region, d.tier,
  c.years_delivered, ch.chronic_years, ch.arrears_pct_latest, r.budget_exec,
  least(greatest(coalesce(r.budget_factor, 0.8e0), 0.8e0), 1e0) AS budget_factor, {flag_columns("budget", "budget")},
  p.year AS liquidity_year, p.liquidity, coalesce(p.liquidity_partial, FALSE) AS liquidity_partial, p.delay_days, p.decay,
  coalesce(p.liquidity < -0.5e0, FALSE) AS liquidity_suspect, coalesce(p.liquidity_stale, FALSE) AS liquidity_stale,
  least(greatest(coalesce(p.rating_factor, 0.8e0), 0.8e0), 1e0) AS liquidity_factor,
  least(greatest(coalesce(a.arrears_factor, 0.8e0), 0.8e0), 1e0) AS arrears_factor, {flag_columns("arrears", "arrears")},
  coalesce(f.compliance_risk, 1e0) AS compliance_risk, coalesce(f.n_severe, 0) AS n_severe,
  coalesce(f.n_moderate, 0) AS n_moderate, coalesce(f.n_light, 0) AS n_light,
  coalesce(f.pending_text, 'REGULAR') AS pending_text, coalesce(f.pending_json, '[]') AS pending_json, u.autonomy_mean,
  {flag_columns("autonomy", "autonomy")}, coalesce(p.rating_preliminary, FALSE) AS liquidity_rating_preliminary,
  coalesce(p.rating_stale, FALSE) AS liquidity_rating_stale,
  CASE WHEN lf.entity_id IS NOT NULL THEN coalesce(p.rating_missing, TRUE) ELSE FALSE END AS liquidity_rating_missing,
  coalesce(h.history, '') AS history,
  least(greatest(coalesce(u.autonomy_factor, 0.8e0), 0.8e0), 1e0) AS autonomy_factor,
  coalesce(u.autonomy_critical, FALSE) AS autonomy_critical, m.n_contracts, m.value_total, m.pct_waiver,
  CASE WHEN m.entity_id IS NOT NULL THEN coalesce(m.pct_waiver > 0.30e0, FALSE) END AS award_alert
FROM x_dim_tier d
LEFT JOIN x_coverage_count c ON c.entity_id = d.entity_id
LEFT JOIN x_chronic_years ch ON ch.entity_id = d.entity_id
LEFT JOIN x_recency r ON r.entity_id = d.entity_id
LEFT JOIN x_pick p ON p.entity_id = d.entity_id
LEFT JOIN x_arrears_rating a ON a.entity_id = d.entity_id
LEFT JOIN x_flags_severity f ON f.entity_id = d.entity_id
LEFT JOIN x_autonomy_profile u ON u.entity_id = d.entity_id
LEFT JOIN x_market_score m ON m.entity_id = d.entity_id
LEFT JOIN (SELECT DISTINCT entity_id FROM x_base WHERE has_fiscal AND year BETWEEN {START} AND {END}) lf
  ON lf.entity_id = d.entity_id
LEFT JOIN (SELECT entity_id, string_agg(year || ':' || CAST(arrears_pct AS DECIMAL(38,2)) || ':'
             || CAST(processed_arrears AS DECIMAL(38,2)) || ':' || CAST(revenue_realized AS DECIMAL(38,2)) || ':' || chronic,
             '|' ORDER BY position) AS history FROM x_history_json GROUP BY entity_id) h ON h.entity_id = d.entity_id
""")
HUB_SPEC = (
    "entity_id:l state:s name:s population:l years_delivered:l chronic_years:l arrears_pct_latest:d budget_exec:d"
    " budget_preliminary:b budget_stale:b budget_missing:b liquidity_year:l liquidity:d liquidity_partial:b liquidity_suspect:b liquidity_stale:b"
    " delay_days:l decay:d liquidity_rating_preliminary:b liquidity_rating_stale:b liquidity_rating_missing:b"
    " arrears_preliminary:b arrears_stale:b arrears_missing:b compliance_risk:d n_severe:l n_moderate:l n_light:l"
    " pending_text:s pending_json:s autonomy_preliminary:b autonomy_stale:b autonomy_missing:b autonomy_mean:d autonomy_critical:b n_contracts:l value_total:d pct_waiver:d award_alert:b"
)


@query("hub_join", HUB_SPEC, source="x_hub")
def hub_join(t: Tables) -> DataFrame:
    return score.indicator_hub(inputs(t), S.WINDOW)


def sql_budget_curve(x: str, digits: int | None = 4) -> str:
    above, below = f"(1e0 - ({x} - 105e0) / 30e0)", f"(({x} - 70e0) / 20e0)"
    if digits is not None:
        above, below = sql_half_even(above, digits), sql_half_even(below, digits)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 120 THEN 0.5e0 WHEN {x} > 105 THEN {above}"
            f" WHEN {x} >= 90 THEN 1e0 WHEN {x} >= 70 THEN {below} ELSE 0e0 END")  # fmt: skip


def sql_liquidity_curve(x: str) -> str:
    c = f"greatest({x}, -0.5e0)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {c} >= 0.35e0 THEN 1e0"
            f" WHEN {c} >= 0.10e0 THEN {sql_half_even(f'(0.60e0 + ({c} - 0.10e0) / 0.25e0 * 0.40e0)', 4)}"
            f" WHEN {c} >= 0 THEN {sql_half_even(f'(0.35e0 + {c} / 0.10e0 * 0.25e0)', 4)}"
            f" ELSE {sql_half_even(f'(({c} + 0.50e0) / 0.50e0 * 0.35e0)', 4)} END")  # fmt: skip


def sql_arrears_curve(n: str) -> str:
    return f"CASE {n} WHEN 0 THEN 1e0 WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.3e0 WHEN 4 THEN 0.1e0 ELSE 0e0 END"


cte("x_norms", f"""
SELECT *, {sql_budget_curve("budget_exec")} AS budget_norm, {sql_liquidity_curve("liquidity")} AS liquidity_norm,
  CASE WHEN autonomy_mean IS NOT NULL THEN {I.sql_sigmoid("autonomy_mean")} END AS autonomy_norm,
  {sql_arrears_curve("chronic_years")} AS arrears_norm, least(years_delivered / {END - START + 1}e0, 1e0) AS coverage
FROM x_hub
""")
cte("x_bases", f"""
SELECT *,
  {sql_half_even("(40e0 * coalesce(liquidity_norm, 0e0) * coalesce(decay, 1e0))", 4)} AS base_liquidity,
  {sql_half_even("(15e0 * coalesce(budget_norm, 0e0))", 4)} AS base_budget_exec,
  {sql_half_even("(15e0 * coalesce(autonomy_norm, 0e0))", 4)} AS base_autonomy,
  {sql_half_even("(20e0 * arrears_norm)", 4)} AS base_arrears,
  0e0 AS points_coverage, {sql_half_even("(10e0 * (1e0 - compliance_risk))", 4)} AS points_compliance
FROM x_norms
""")
cte("x_components", f"""
SELECT *,
  {sql_half_even("(base_liquidity * liquidity_factor)", 4)} AS points_liquidity,
  {sql_half_even("(base_budget_exec * budget_factor)", 4)} AS points_budget_exec,
  {sql_half_even("(base_autonomy * autonomy_factor)", 4)} AS points_autonomy,
  {sql_half_even("(base_arrears * arrears_factor)", 4)} AS points_arrears,
  {sql_half_even("((liquidity_factor * 40e0 + budget_factor * 15e0 + autonomy_factor * 15e0 + arrears_factor * 20e0) / 90e0)", 6)}
    AS mean_factor
FROM x_bases
""")
cte("x_final", f"""
SELECT *, CASE WHEN budget_exec IS NOT NULL THEN {sql_half_even("score_raw", 1)} END AS score FROM (
  SELECT *, greatest(score_base + penalty, 0e0) AS score_raw FROM (
    SELECT *, base_liquidity + base_budget_exec + points_coverage + points_compliance + base_autonomy + base_arrears
                AS score_base_unrated,
      points_liquidity + points_budget_exec + points_coverage + points_compliance + points_autonomy + points_arrears
                AS score_base,
      CASE WHEN liquidity_partial THEN -5e0 ELSE 0e0 END AS penalty FROM x_components))
""")


def sql_class(score: str, years: str, chronic: str, cuts, labels, no_data) -> str:
    rank = (f"greatest(CASE WHEN {score} >= {cuts[0]} THEN 1 WHEN {score} >= {cuts[1]} THEN 2 WHEN {score} >= {cuts[2]} THEN 3"
            f" ELSE 4 END, CASE WHEN {chronic} >= 4 THEN 2 ELSE 1 END,"
            f" CASE WHEN {years} <= 2 THEN 3 WHEN {years} = 3 THEN 2 ELSE 1 END)")  # fmt: skip
    return f"CASE WHEN {score} IS NULL OR {years} = 0 THEN '{no_data}' ELSE list_extract([{sql_list(labels)}], {rank}) END"


MAIN_CLASS = (P.SCORE_CUTS, P.RISK_CLASSES, P.NO_DATA_CLASS)
BACKTEST_CLASS = (P.BACKTEST_CUTS, P.BACKTEST_CLASSES, P.BACKTEST_NO_DATA)
cte("x_scored", f"""
SELECT *, {sql_class("score", "years_delivered", "chronic_years", *MAIN_CLASS)} AS risk_class FROM x_final
""")
NORM_SPEC = "budget_norm:d liquidity_norm:d autonomy_norm:d arrears_norm:d coverage:d"
POINT_SPEC = (
    "base_liquidity:d base_budget_exec:d base_autonomy:d base_arrears:d points_liquidity:d points_budget_exec:d"
    " points_autonomy:d points_arrears:d points_coverage:d points_compliance:d mean_factor:d"
)
FACTOR_SPEC = "budget_factor:d liquidity_factor:d arrears_factor:d autonomy_factor:d"


def components(t: Tables) -> DataFrame:
    return score.score_components(score.indicator_hub(inputs(t), S.WINDOW), S.WINDOW)


@query("score_components", f"entity_id:l state:s region:s {FACTOR_SPEC} {NORM_SPEC} {POINT_SPEC}", source="x_components")
def score_components(t: Tables) -> DataFrame:
    return components(t)


FINAL_SPEC = "score_base_unrated:d score_base:d penalty:d score_raw:d score:d"


@query("final_score", f"entity_id:l state:s {FINAL_SPEC}", source="x_final")
def final_score(t: Tables) -> DataFrame:
    return score.final_score(components(t))


SCORE_SPEC = f"{HUB_SPEC} {FACTOR_SPEC} {NORM_SPEC} {POINT_SPEC} {FINAL_SPEC} risk_class:s history:s"


def with_history(scored: DataFrame) -> DataFrame:
    """The JSON history, parsed back, in a notation that SQL can write as well."""
    parsed = F.from_json("arrears_history_json", I.HISTORY_TYPE)
    fields = ("arrears_pct", "processed_arrears", "revenue_realized")
    entry = lambda h: F.concat_ws(":", h["year"], *[h[f].cast("decimal(38,2)") for f in fields], h["chronic"])
    return scored.withColumn("history", F.array_join(F.transform(parsed, entry), "|"))


@query("score_job", SCORE_SPEC, source="x_scored")
def score_job(t: Tables) -> DataFrame:
    return with_history(score.score_job(inputs(t), S.WINDOW, ranked=False))


def raw_inputs(t: Tables) -> score.Inputs:
    S.write_orders(t)
    lines = S.raw_lines(S.budget_lines(t)), S.raw_lines(S.fiscal_lines(t))
    return score.Inputs(S.raw_dim(t), *lines, S.raw_accounts(t), S.raw_ratings(t), S.raw_flags(t), S.raw_contracts(t))


@query("score_from_raw", SCORE_SPEC, source="x_scored")
def score_from_raw(t: Tables) -> DataFrame:
    """From all-text tables, with repeated and outdated rows, through staging to the score."""
    return with_history(score.score_job(score.staged_inputs(raw_inputs(t)), S.WINDOW, ranked=False))


@query(
    "score_ranking",
    "place:l entity_id:l risk_class:s score:d",
    f"""SELECT row_number() OVER (ORDER BY list_position({S.CLASS_LIST}, risk_class), score DESC NULLS LAST, entity_id)
              AS place, entity_id, risk_class, score FROM x_scored""",
)
def score_ranking(t: Tables) -> DataFrame:
    return score.ranking(score.score_job(inputs(t), S.WINDOW, ranked=False))


@query(
    "class_distribution",
    "risk_class:s n_entities:l",
    "SELECT risk_class, count(*) AS n_entities FROM x_scored GROUP BY risk_class",
)
def class_distribution(t: Tables) -> DataFrame:
    return history.class_distribution(score.score_job(inputs(t), S.WINDOW, ranked=False))


@query(
    "score_summary",
    "state:s rows_written:l rows_scored:l rows_no_data:l score_avg:d score_median:d score_min:d score_max:d",
    f"""SELECT state, count(*) AS rows_written, count(score) AS rows_scored,
              count(*) FILTER (WHERE risk_class = '{P.NO_DATA_CLASS}') AS rows_no_data, {sql_exact_mean("score", 4)} AS score_avg,
              median(score) AS score_median, min(score) AS score_min, max(score) AS score_max FROM x_scored GROUP BY state""",
)
def score_summary(t: Tables) -> DataFrame:
    return history.run_summary(score.score_job(inputs(t), S.WINDOW, ranked=False), ["state"])


CLASSIFY_SQL = """SELECT o_orderkey AS id, {cls} AS risk_class FROM (
  SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN round_even(o_totalprice / 5000e0 * 1e1, 0) / 1e1 + 0e0 END AS s,
         month(o_orderdate) % 7 AS y, day(o_orderdate) % 6 AS c FROM orders)"""


def classified(t: Tables, cuts, labels, no_data) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    points = half_even(F.col("o_totalprice") / 5000.0, 1)
    value = F.when(F.col("o_orderpriority") != "5-LOW", points)
    rank = class_rank(value, F.month(day) % 7, F.dayofmonth(day) % 6, cuts)
    return t.orders.select(F.col("o_orderkey").alias("id"), class_label(rank, labels, no_data).alias("risk_class"))


@query("classify", "id:l risk_class:s", CLASSIFY_SQL.format(cls=sql_class("s", "y", "c", *MAIN_CLASS)))
def classify(t: Tables) -> DataFrame:
    return classified(t, *MAIN_CLASS)


@query("classify_params", "id:l risk_class:s", CLASSIFY_SQL.format(cls=sql_class("s", "y", "c", *BACKTEST_CLASS)))
def classify_params(t: Tables) -> DataFrame:
    return classified(t, *BACKTEST_CLASS)


# --- older scoring path ------------------------------------------------------------------

LEGACY_DECAY = I.sql_decay("delay_days")
cte("x_legacy", f"""
SELECT *, CASE WHEN budget_exec IS NOT NULL THEN {sql_half_even("score_raw", 1)} END AS score FROM (
SELECT *, greatest(points_liquidity + points_budget_exec + 0e0 + points_compliance + points_autonomy + points_arrears
                   + CASE WHEN liquidity_partial THEN -5e0 ELSE 0e0 END, 0e0) AS score_raw FROM (
SELECT *,
  CASE WHEN liquidity IS NOT NULL THEN {sql_half_even(f"(40e0 * ({sql_liquidity_curve('liquidity')}) * decay)", 4)}
       ELSE 0e0 END AS points_liquidity,
  {sql_half_even(f"(15e0 * coalesce({sql_budget_curve('budget_exec')}, 0e0))", 4)} AS points_budget_exec,
  {sql_half_even("(10e0 * (1e0 - compliance_risk))", 4)} AS points_compliance,
  coalesce({sql_half_even(f"(15e0 * CASE WHEN autonomy_mean IS NOT NULL THEN {I.sql_sigmoid('autonomy_mean')} END)", 4)}, 0e0)
    AS points_autonomy,
  CASE WHEN arrears_years > 0 THEN {sql_half_even(f"(20e0 * ({sql_arrears_curve('chronic_years')}))", 4)} ELSE 0e0 END
    AS points_arrears
FROM (
SELECT d.entity_id, d.state, d.population, d.region, d.tier, b.budget_exec,
  coalesce(y.years_delivered, 0) AS years_delivered, coalesce(y.chronic_years, 0) AS chronic_years,
  coalesce(y.arrears_years, 0) AS arrears_years, l.liquidity, coalesce(l.liquidity_partial, FALSE) AS liquidity_partial,
  l.decay, t.compliance_risk, a.autonomy_mean
FROM x_dim_tier d
LEFT JOIN x_weighted_recency_present b ON b.entity_id = d.entity_id
LEFT JOIN (SELECT entity_id, count(*) FILTER (WHERE delivered) AS years_delivered,
             count(*) FILTER (WHERE delivered AND arrears_pct IS NOT NULL) AS arrears_years,
             count(*) FILTER (WHERE delivered AND arrears_pct > 3e0) AS chronic_years
           FROM x_indicators WHERE year BETWEEN {START} AND {END} GROUP BY entity_id) y ON y.entity_id = d.entity_id
LEFT JOIN (SELECT *, {LEGACY_DECAY} AS decay FROM (
             SELECT *, {I.DELAY_SQL} AS delay_days, row_number() OVER (PARTITION BY entity_id ORDER BY year DESC,
                      fiscal_period DESC NULLS LAST, CASE fiscal_regime WHEN 'Q' THEN 0 ELSE 1 END) AS rn
             FROM x_indicators WHERE liquidity IS NOT NULL AND year BETWEEN {START} AND {END}) WHERE rn = 1) l
  ON l.entity_id = d.entity_id
LEFT JOIN x_flags_text_score t ON t.entity_id = d.entity_id
LEFT JOIN x_fallback a ON a.entity_id = d.entity_id)))
""")


@query(
    "score_legacy",
    "entity_id:l state:s budget_exec:d years_delivered:l chronic_years:l liquidity:d points_liquidity:d"
    " points_budget_exec:d points_compliance:d points_autonomy:d points_arrears:d score_raw:d score:d risk_class:s",
    f"SELECT *, {sql_class('score', 'years_delivered', 'chronic_years', *MAIN_CLASS)} AS risk_class FROM x_legacy",
)
def score_legacy(t: Tables) -> DataFrame:
    text = FL.pending_flags_row(S.flags(t))
    rows = I.indicators(t)
    autonomy = fallback_ratios(S.accounts(t), rows).select("entity_id", "autonomy_mean")
    return score.score_legacy(rows, S.dim(t), text, autonomy, S.WINDOW)


@query(
    "score_enrich",
    "entity_id:l score:d risk_class:s n_contracts:l value_total:d n_waiver:l value_waiver:d pct_waiver:d award_alert:b"
    " last_year:l",
    """SELECT s.entity_id, s.score, s.risk_class, m.n_contracts, m.value_total, m.n_waiver, m.value_waiver, m.pct_waiver,
              m.award_alert, m.last_year FROM x_scored s LEFT JOIN x_market12 m ON m.entity_id = s.entity_id""",
)
def score_enrich(t: Tables) -> DataFrame:
    return enriched(t)


def enriched(t: Tables) -> DataFrame:
    scored = score.score_job(inputs(t), S.WINDOW, ranked=False).select("entity_id", "score", "risk_class", "liquidity")
    return market.score_enrich(scored, S.contracts(t), S.CONTRACTS_AS_OF)


@query(
    "score_enrich_report",
    "report_group:s n_entities:l n_contracts:l value_total:d",
    f"""SELECT report_group, count(*) AS n_entities, coalesce(sum(n_contracts), 0) AS n_contracts,
              coalesce({sql_exact_sum("value_total")}, 0e0) AS value_total FROM (
         SELECT m.*, unnest(list_filter([
             CASE WHEN risk_class = '{P.RISK_CLASSES[0]}' THEN 'low_risk' END,
             CASE WHEN coalesce(liquidity, 0e0) < 0 THEN 'negative_liquidity' END,
             CASE WHEN risk_class = '{P.NO_DATA_CLASS}' AND n_contracts IS NOT NULL THEN 'no_data_with_contracts' END,
             CASE WHEN risk_class IN ({sql_list(P.RISK_CLASSES[2:])}) AND award_alert THEN 'high_risk_with_alert' END],
             lambda g: g IS NOT NULL)) AS report_group
         FROM (SELECT s.risk_class, s.liquidity, k.n_contracts, k.value_total, k.award_alert
               FROM x_scored s LEFT JOIN x_market12 k ON k.entity_id = s.entity_id) m)
       GROUP BY report_group""",
)
def score_enrich_report(t: Tables) -> DataFrame:
    return market.enrich_report(enriched(t))

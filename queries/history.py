"""Snapshot-history and back-test queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import indicators as I
from queries import shapes as S
from queries import scores as SC
from queries.core import Tables, cte, query, sql_case, sql_exact_mean, sql_half_even, sql_list
from riskspark import params as P
from riskspark.operators import ranks as RK
from riskspark.operators.asof import attach_rating
from riskspark.plans import backtest as BT
from riskspark.plans import grades as G
from riskspark.plans import history as H
from riskspark.plans import history_state as HS

FIRST, LAST = S.FIRST_YEAR, S.LAST_YEAR

# --- snapshots ---------------------------------------------------------------------------

SNAPSHOT_SPEC = "run_id:s snapshot_date:dt state:s entity_id:s name:s score:d risk_class:s n_severe:l compliance_risk:d"
NEWEST = "PARTITION BY state, entity_id ORDER BY snapshot_ts DESC, run_id DESC"


@query(
    "snapshot_latest",
    SNAPSHOT_SPEC,
    f"SELECT * FROM (SELECT *, row_number() OVER ({NEWEST}) AS rn FROM x_snapshots) WHERE rn = 1",
)
def snapshot_latest(t: Tables) -> DataFrame:
    return H.latest(S.snapshots(t))


@query("snapshot_trajectory", "run_id:s snapshot_date:dt state:s entity_id:s name:s score:d risk_class:s n_severe:l"
       " chronic_years:l", source="x_snapshots")  # fmt: skip
def snapshot_trajectory(t: Tables) -> DataFrame:
    return H.trajectory(S.snapshots(t))


@query(
    "snapshot_diff",
    "run_id:s snapshot_date:dt state:s entity_id:s score:d previous_score:d delta_score:d risk_class:s"
    " previous_risk_class:s class_changed:b n_severe:l previous_n_severe:l previous_compliance_risk:d previous_run_id:s",
    f"""SELECT *, score - previous_score AS delta_score, risk_class <> previous_risk_class AS class_changed FROM (
         SELECT *, row_number() OVER ({NEWEST}) AS rn, lead(run_id) OVER ({NEWEST}) AS previous_run_id,
                lead(score) OVER ({NEWEST}) AS previous_score, lead(risk_class) OVER ({NEWEST}) AS previous_risk_class,
                lead(n_severe) OVER ({NEWEST}) AS previous_n_severe,
                lead(compliance_risk) OVER ({NEWEST}) AS previous_compliance_risk FROM x_snapshots) WHERE rn = 1""",
)
def snapshot_diff(t: Tables) -> DataFrame:
    return H.diff_last_run(S.snapshots(t))


def sql_frame(n: int, what: str) -> str:
    return (f"{what} OVER (PARTITION BY state, entity_id ORDER BY snapshot_ts, run_id"
            f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")  # fmt: skip


@query(
    "flag_persistence",
    "run_id:s snapshot_date:dt state:s entity_id:s n_severe:l has_severe:b n_severe_last_6:l n_severe_last_12:l"
    " persistent_6:b persistent_12:b",
    f"""SELECT *, f6 = 6 AND n_severe_last_6 = 6 AS persistent_6, f12 = 12 AND n_severe_last_12 = 12 AS persistent_12 FROM (
         SELECT *, n_severe > 0 AS has_severe, {sql_frame(6, "count(*)")} AS f6, {sql_frame(12, "count(*)")} AS f12,
                {sql_frame(6, "sum(CASE WHEN n_severe > 0 THEN 1 ELSE 0 END)")} AS n_severe_last_6,
                {sql_frame(12, "sum(CASE WHEN n_severe > 0 THEN 1 ELSE 0 END)")} AS n_severe_last_12 FROM x_snapshots)""",
)
def flag_persistence(t: Tables) -> DataFrame:
    return H.flag_persistence(S.snapshots(t))


def newest_state(t: Tables) -> DataFrame:
    """The state of the newest snapshots after two publications, the second with some days again."""

    def build(t: Tables) -> DataFrame:
        path, rows = t.path("history-state"), S.snapshots(t)
        day = F.col("snapshot_date")
        last = rows.agg(F.max("snapshot_date")).first()[0]
        first = rows.filter(day < F.date_sub(F.lit(last), 10)).withColumn("score", F.lit(0.0))
        HS.update_state(first, first, path)
        HS.update_state(rows, rows, path)
        return HS.read_state(t.spark, path)

    return t.shared("newest_state", build)


@query(
    "state_diff",
    "run_id:s snapshot_date:dt state:s entity_id:s score:d previous_score:d delta_score:d risk_class:s"
    " previous_risk_class:s class_changed:b n_severe:l previous_n_severe:l previous_compliance_risk:d previous_run_id:s",
    source="x_snapshot_diff",
)
def state_diff(t: Tables) -> DataFrame:
    return HS.diff_from_state(newest_state(t))


@query(
    "state_persistence",
    "run_id:s snapshot_date:dt state:s entity_id:s n_severe:l has_severe:b n_severe_last_6:l n_severe_last_12:l"
    " persistent_6:b persistent_12:b",
    f"SELECT * FROM (SELECT *, row_number() OVER ({NEWEST}) AS place FROM x_flag_persistence) WHERE place = 1",
)
def state_persistence(t: Tables) -> DataFrame:
    return HS.persistence_from_state(newest_state(t))


@query(
    "run_summary",
    "snapshot_date:dt state:s rows_written:l rows_scored:l rows_no_data:l score_avg:d score_median:d score_min:d score_max:d",
    f"""SELECT snapshot_date, state, count(*) AS rows_written, count(score) AS rows_scored,
              count(*) FILTER (WHERE risk_class = '{P.NO_DATA_CLASS}') AS rows_no_data,
              {sql_exact_mean("score", 4)} AS score_avg, median(score) AS score_median, min(score) AS score_min,
              max(score) AS score_max FROM x_snapshots GROUP BY snapshot_date, state""",
)
def run_summary(t: Tables) -> DataFrame:
    return H.run_summary(S.snapshots(t), ["snapshot_date", "state"])


# --- back-test pairs ---------------------------------------------------------------------


def annual(t: Tables) -> DataFrame:
    return t.shared("annual", lambda t: attach_rating(I.indicators(t), S.ratings(t)))


cte("x_annual", """
SELECT i.*, r.rating_factor FROM x_indicators i
JOIN (SELECT entity_id, year, rating_factor FROM (
        SELECT t.entity_id, t.year, coalesce(r.factor, 0.8e0) AS rating_factor,
               row_number() OVER (PARTITION BY t.entity_id, t.year ORDER BY r.year DESC NULLS LAST) AS rn
        FROM x_indicators t LEFT JOIN x_ratings r ON r.entity_id = t.entity_id AND r.year <= t.year) WHERE rn = 1) r
  ON r.entity_id = i.entity_id AND r.year = i.year
""")


@query(
    "walk_forward_pairs",
    "entity_id:l year:l next_year:l arrears_pct:d next_arrears_pct:d",
    """SELECT a.entity_id, a.year, b.year AS next_year, a.arrears_pct, b.arrears_pct AS next_arrears_pct
       FROM x_indicators a JOIN x_indicators b ON b.entity_id = a.entity_id AND b.year = a.year + 1""",
)
def walk_forward_pairs(t: Tables) -> DataFrame:
    return BT.walk_forward_pairs(I.indicators(t), ["year", "arrears_pct"])


cte("x_history", f"""
SELECT a.entity_id, a.year,
  (SELECT count(*) FROM x_annual h WHERE h.entity_id = a.entity_id AND h.year BETWEEN {FIRST} AND a.year AND h.delivered)
    AS years_delivered,
  (SELECT count(*) FROM x_annual h WHERE h.entity_id = a.entity_id AND h.year < a.year AND h.arrears_pct > 3e0)
    AS chronic_before,
  (SELECT {sql_exact_mean("rating_factor", 10)} FROM x_annual h WHERE h.entity_id = a.entity_id AND h.year < a.year
     AND h.arrears_pct IS NOT NULL) AS arrears_factor_before
FROM x_annual a
""")


@query(
    "history_to_date",
    "entity_id:l year:l years_delivered:l chronic_before:l arrears_factor_before:d",
    source="x_history",
)
def history_to_date(t: Tables) -> DataFrame:
    return BT.history_to_date(annual(t), FIRST)


W_SQL = "CASE rn WHEN 1 THEN 40e0 WHEN 2 THEN 25e0 WHEN 3 THEN 20e0 WHEN 4 THEN 10e0 WHEN 5 THEN 5e0 END"
cte("x_topk", f"""
SELECT a.entity_id, a.year, k.budget_weighted, coalesce(k.budget_factor, 0.8e0) AS budget_factor FROM x_annual a
LEFT JOIN (SELECT entity_id, t0, reduce(list(w * x ORDER BY rn), lambda p, q: p + q) / sum(w) AS budget_weighted,
             reduce(list(w * f ORDER BY rn), lambda p, q: p + q) / sum(w) AS budget_factor
      FROM (SELECT *, {W_SQL} AS w FROM (
        SELECT t.entity_id, t.year AS t0, h.budget_exec AS x, h.rating_factor AS f,
               row_number() OVER (PARTITION BY t.entity_id, t.year ORDER BY h.year DESC) AS rn
        FROM x_annual t JOIN x_annual h ON h.entity_id = t.entity_id AND h.year <= t.year AND h.budget_exec IS NOT NULL)
        WHERE rn <= 5) GROUP BY entity_id, t0) k ON k.entity_id = a.entity_id AND k.t0 = a.year
""")


@query("topk_weighted", "entity_id:l year:l budget_weighted:d budget_factor:d", source="x_topk")
def topk_weighted(t: Tables) -> DataFrame:
    return BT.top_years_weighted(annual(t))


def sql_backtest(with_arrears: bool, exclude: tuple[int, ...] = ()) -> str:
    arrears_weight = "20e0" if with_arrears else "0e0"
    liquidity_weight = "(CASE WHEN liquidity IS NULL THEN 0e0 ELSE 40e0 END)"
    weights = f"({liquidity_weight} + 10e0 + 15e0 + 0e0 + 15e0 + {arrears_weight})"
    rated_weights = f"({liquidity_weight} + 0e0 + 15e0 + 0e0 + 15e0 + {arrears_weight})"
    arrears = "coalesce(arrears_norm, 0.5e0) * 20e0" if with_arrears else "0e0"
    liquidity = "(CASE WHEN liquidity IS NULL THEN 0e0 ELSE coalesce(liquidity_norm, 0.5e0) * 40e0{f} END)"
    plain = (f"({liquidity.format(f='')} + 1e0 * 10e0 + coalesce(budget_norm0, 0.5e0) * 15e0 + coverage0 * 0e0"
             f" + 0.5e0 * 15e0 + {arrears}) / {weights} * 100e0")  # fmt: skip
    factored = (f"({liquidity.format(f=' * liquidity_factor0')} + 1e0 * 10e0 * 1e0"
                f" + coalesce(budget_norm0, 0.5e0) * 15e0 * budget_factor0 + coverage0 * 0e0 * 1e0"
                f" + 0.5e0 * 15e0 * liquidity_factor0 + {arrears + ' * arrears_factor0' if with_arrears else '0e0'})"
                f" / {weights} * 100e0")  # fmt: skip
    mean = (f"((CASE WHEN liquidity IS NULL THEN 0e0 ELSE 40e0 * liquidity_factor0 END) + 0e0 + 15e0 * budget_factor0 + 0e0"
            f" + 15e0 * liquidity_factor0 + {'20e0 * arrears_factor0' if with_arrears else '0e0'}) / {rated_weights}")  # fmt: skip
    skip = f"AND a.year NOT IN ({', '.join(map(str, exclude))})" if exclude else ""
    cls = SC.sql_class("score", "years_delivered", "chronic_years", *SC.BACKTEST_CLASS)
    return f"""
SELECT *, {cls} AS risk_class FROM (
SELECT *, {sql_half_even(factored, 2)} AS score, {sql_half_even(plain, 2)} AS score_unrated,
  {sql_half_even(mean, 6)} AS mean_factor, CASE WHEN liquidity IS NULL THEN 'parcial' ELSE 'completa' END AS era,
  {sql_half_even("liquidity_factor0", 6)} AS liquidity_factor, {sql_half_even("budget_weighted0", 2)} AS budget_weighted,
  {sql_half_even("budget_norm0", 4)} AS budget_norm, {sql_half_even("budget_factor0", 6)} AS budget_factor,
  {sql_half_even("coverage0", 4)} AS coverage, {sql_half_even("arrears_factor0", 6)} AS arrears_factor,
  coalesce(liquidity < -0.5e0, FALSE) AS suspect
FROM (
SELECT a.entity_id, a.state, {I.REGION_SQL.replace("state IN", "a.state IN")} AS region, a.name, a.population,
  a.year AS year_t0, b.year AS year_t1, a.liquidity, {SC.sql_liquidity_curve("a.liquidity")} AS liquidity_norm,
  a.rating_factor AS liquidity_factor0, k.budget_weighted AS budget_weighted0,
  {SC.sql_budget_curve("k.budget_weighted", None)} AS budget_norm0, k.budget_factor AS budget_factor0,
  least(h.years_delivered / (a.year - {FIRST} + 1)::DOUBLE, 1e0) AS coverage0, h.years_delivered,
  h.chronic_before AS chronic_years, {SC.sql_arrears_curve("h.chronic_before")} AS arrears_norm,
  coalesce(h.arrears_factor_before, 0.8e0) AS arrears_factor0, a.arrears_pct AS arrears_t0, b.arrears_pct AS outcome
FROM x_annual a
JOIN x_annual b ON b.entity_id = a.entity_id AND b.year = a.year + 1
JOIN x_history h ON h.entity_id = a.entity_id AND h.year = a.year
JOIN x_topk k ON k.entity_id = a.entity_id AND k.year = a.year
WHERE a.year BETWEEN {FIRST} AND {LAST - 1} AND b.arrears_pct IS NOT NULL
  AND (b.year < {LAST} OR b.fiscal_period IS NOT NULL) {skip}))
"""


cte("x_pairs", sql_backtest(True))
cte("x_pairs_no_arrears", sql_backtest(False, (FIRST,)))
PAIR_SPEC = (
    "state:s region:s entity_id:l name:s population:l year_t0:l year_t1:l era:s score:d score_unrated:d mean_factor:d"
    " risk_class:s liquidity:d liquidity_norm:d liquidity_factor:d budget_weighted:d budget_norm:d budget_factor:d"
    " coverage:d years_delivered:l chronic_years:l arrears_norm:d arrears_factor:d arrears_t0:d outcome:d suspect:b"
)


def pairs(t: Tables) -> DataFrame:
    return t.shared("pairs", lambda t: BT.backtest_pairs(annual(t), FIRST, LAST))


def saved_pairs(t: Tables) -> DataFrame:
    """Pairs as a written table: every report reads it several times, the history is read once."""

    def build(t: Tables) -> DataFrame:
        path = t.path("pairs")
        pairs(t).write.parquet(path)
        return t.spark.read.parquet(path)

    return t.shared("saved_pairs", build)


@query("backtest_pairs", PAIR_SPEC, source="x_pairs")
def backtest_pairs(t: Tables) -> DataFrame:
    return pairs(t)


@query("backtest_no_arrears", PAIR_SPEC, source="x_pairs_no_arrears")
def backtest_no_arrears(t: Tables) -> DataFrame:
    return BT.backtest_pairs(annual(t), FIRST, LAST, with_arrears=False, exclude_t0=(FIRST,))


@query(
    "score_redistributed",
    "entity_id:l year_t0:l era:s score:d score_unrated:d mean_factor:d",
    "SELECT * FROM x_pairs",
)
def score_redistributed(t: Tables) -> DataFrame:
    """Both eras, each from its own run."""
    eras = [BT.backtest_pairs(annual(t), FIRST, LAST, era=era) for era in (BT.ERA_PARTIAL, BT.ERA_COMPLETE)]
    return eras[0].unionByName(eras[1])


@query(
    "pairs_by_state",
    "state:s n_pairs:l entities:l score_mean:d outcome_median:d",
    f"""SELECT state, count(score) AS n_pairs, count(DISTINCT entity_id) AS entities, {sql_exact_mean("score", 4)} AS score_mean,
              median(outcome) AS outcome_median FROM x_pairs GROUP BY state""",
)
def pairs_by_state(t: Tables) -> DataFrame:
    return RK.coverage_by_group(saved_pairs(t), "state")


@query(
    "outcome_by_class",
    "risk_class:s n_pairs:l median_outcome:d pct_chronic:d",
    f"""SELECT risk_class, count(*) AS n_pairs, {sql_half_even("median(outcome)", 2)} AS median_outcome,
              {sql_half_even("(count(*) FILTER (WHERE outcome > 3e0) * 100e0 / count(*))", 1)} AS pct_chronic
       FROM x_pairs GROUP BY risk_class""",
)
def outcome_by_class(t: Tables) -> DataFrame:
    return RK.outcome_by_class(saved_pairs(t))


CORRELATION = "NULLIF(corr(rs, ro), CAST('nan' AS DOUBLE))"  # not a number without any spread


def sql_spearman(table: str, group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    ranks = ", ".join(
        f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}{c}) - 1) / 2e0 AS r{c[0]}"
        for c in ("score", "outcome")
    )
    by = f"GROUP BY {group}" if group else ""
    return (f"SELECT {keys}count(*) AS n_pairs, {sql_half_even(CORRELATION, 4)} AS spearman"
            f" FROM (SELECT *, {ranks} FROM {table}) {by}")  # fmt: skip


def sql_auc(table: str, group: str = "", score: str = "score", event: str = "outcome > 3e0", low_is_risky: bool = True,
            min_positives: int = 1) -> str:
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    order = f"100e0 - {score}" if low_is_risky else score
    by = f"GROUP BY {group}" if group else ""
    n1, n0 = f"count(*) FILTER (WHERE {event})", f"count(*) FILTER (WHERE NOT ({event}))"
    area = f"((sum(rk) FILTER (WHERE {event}) - {n1} * ({n1} + 1) / 2e0) / NULLIF({n1}::DOUBLE * {n0}, 0e0))"
    return (f"SELECT {keys}count(*) AS n_pairs, {n1} AS n_positives, CASE WHEN {n1} >= {min_positives} THEN"
            f" {sql_half_even(area, 4)} END AS auc FROM (SELECT *, rank() OVER ({part} ORDER BY {order})"
            f" + (count(*) OVER (PARTITION BY {keys}{score}) - 1) / 2e0 AS rk FROM {table}) {by}")  # fmt: skip


@query("spearman", "n_pairs:l spearman:d", sql_spearman("x_pairs"))
def spearman(t: Tables) -> DataFrame:
    return RK.spearman(RK.pair_counts(saved_pairs(t), ["score", "outcome"]), [], "score", "outcome")


@query("spearman_by_state", "state:s n_pairs:l spearman:d", sql_spearman("x_pairs", "state"))
def spearman_by_state(t: Tables) -> DataFrame:
    return RK.spearman(RK.pair_counts(saved_pairs(t), ["state", "score", "outcome"]), ["state"], "score", "outcome")


def sql_cosine_area(low: str) -> str:
    """Simpson's rule with 400 steps for cos(x) ** (f - 1) from ``low`` to e."""
    x = f"({low} + (e - {low}) * i / 400e0)"
    weight = "CASE WHEN i IN (0, 400) THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END"
    return f"(SELECT sum(({weight}) * pow(cos({x}), f - 1e0)) FROM range(401) AS s(i)) * (e - {low}) / 1200e0"


# Student's t: with x = atan(t / sqrt(f)) the tail is the share of the area of cos(x) ** (f - 1) beyond x
SQL_P_VALUE = f"""SELECT n_pairs, spearman, CASE WHEN n_pairs < 3 OR spearman IS NULL THEN NULL WHEN abs(spearman) >= 1 THEN 0e0
  ELSE {sql_half_even(f"({sql_cosine_area('a')} / ({sql_cosine_area('0e0')}))", 4)} END AS p_value
FROM (SELECT *, least(pi() / 2e0, 9e0 / sqrt(f)) AS e, least(atan(abs(spearman * sqrt(f / (1e0 - spearman * spearman))) / sqrt(f)),
        least(pi() / 2e0, 9e0 / sqrt(f))) AS a
      FROM (SELECT *, CAST(n_pairs - 2 AS DOUBLE) AS f FROM ({{rows}})))"""


@query("spearman_pvalue", "n_pairs:l spearman:d p_value:d", SQL_P_VALUE.format(rows=sql_spearman("x_pairs")))
def spearman_pvalue(t: Tables) -> DataFrame:
    return RK.with_p_value(RK.spearman(RK.pair_counts(saved_pairs(t), ["score", "outcome"]), [], "score", "outcome"))


@query(
    "spearman_pvalue_by_state",
    "state:s n_pairs:l spearman:d p_value:d",
    SQL_P_VALUE.replace("SELECT n_pairs", "SELECT state, n_pairs", 1).format(rows=sql_spearman("x_pairs", "state")),
)
def spearman_pvalue_by_state(t: Tables) -> DataFrame:
    counts = RK.pair_counts(saved_pairs(t), ["state", "score", "outcome"])
    return RK.with_p_value(RK.spearman(counts, ["state"], "score", "outcome"))


@query("auc_roc", "n_pairs:l n_positives:l auc:d", sql_auc("x_pairs", min_positives=3))
def auc_roc(t: Tables) -> DataFrame:
    event = F.col("outcome") > P.CHRONIC_ARREARS_PCT
    return RK.auc(RK.pair_counts(saved_pairs(t), ["score", "outcome"]), [], "score", event, min_positives=3)


def sql_metrics(group: str) -> str:
    rows = f"(SELECT p.*, e.base FROM x_pairs p, (VALUES ('{P.BASE_COMPLETE}'), ('{P.BASE_TOTAL}')) AS e(base)"
    rows += f" WHERE e.base = '{P.BASE_TOTAL}' OR p.era = 'completa')"
    key = f"{group}, base"
    return f"""
SELECT m.*, CASE WHEN abs(spearman) >= 0.30e0 THEN 'forte' WHEN abs(spearman) >= 0.10e0 THEN 'moderado'
                 WHEN spearman IS NOT NULL THEN 'fraco' END AS spearman_strength,
  CASE WHEN auc >= 0.80e0 THEN 'forte' WHEN auc >= 0.70e0 THEN 'moderado' WHEN auc >= 0.60e0 THEN 'fraco'
       WHEN auc IS NOT NULL THEN 'baixo' END AS auc_strength,
  CASE WHEN spearman IS NULL AND auc IS NULL THEN '{P.READ_TOO_SMALL}' WHEN spearman IS NULL THEN '{P.READ_AUC_ONLY}'
       WHEN auc IS NULL THEN '{P.READ_CORRELATION_ONLY}'
       WHEN abs(spearman) >= 0.30e0 AND auc >= 0.70e0 THEN '{P.READ_CONSISTENT}'
       WHEN abs(spearman) >= 0.20e0 AND auc >= 0.65e0 THEN '{P.READ_CLEAR}'
       WHEN abs(spearman) >= 0.10e0 AND auc >= 0.60e0 THEN '{P.READ_LIMITED}' ELSE '{P.READ_UNSTABLE}' END AS reading
FROM (
SELECT l.*, e.entities, e.n_total, CASE WHEN l.n_pairs >= 3 THEN s.spearman END AS spearman,
       CASE WHEN l.n_pairs >= 3 THEN a.auc END AS auc,
       row_number() OVER (PARTITION BY l.{group} ORDER BY CASE l.base WHEN '{P.BASE_COMPLETE}' THEN 0 ELSE 1 END) AS rn
FROM (SELECT {key}, count(*) AS n_pairs, count(*) FILTER (WHERE outcome > 3e0) AS positives,
        {sql_half_even("(count(*) FILTER (WHERE outcome > 3e0) * 100e0 / count(*))", 1)} AS pct_positives,
        {sql_half_even("(CAST(sum(CAST(score AS DECIMAL(38,4))) AS DOUBLE) / count(*))", 2)} AS score_mean,
        {sql_half_even("median(outcome)", 2)} AS outcome_median
      FROM {rows} GROUP BY {key}) l
JOIN ({sql_spearman(rows, key)}) s ON s.{group} = l.{group} AND s.base = l.base
JOIN ({sql_auc(rows, key, min_positives=3)}) a ON a.{group} = l.{group} AND a.base = l.base
JOIN (SELECT {group}, count(DISTINCT entity_id) AS entities, count(*) AS n_total FROM x_pairs GROUP BY {group}) e
  ON e.{group} = l.{group}
WHERE l.base = '{P.BASE_TOTAL}' OR l.n_pairs >= 30) m WHERE rn = 1
"""


METRIC_SPEC = (
    "base:s n_pairs:l n_total:l entities:l positives:l pct_positives:d spearman:d auc:d score_mean:d outcome_median:d"
    " spearman_strength:s auc_strength:s reading:s"
)


@query("metrics_by_group", f"region:s {METRIC_SPEC}", sql_metrics("region"))
def metrics_by_region(t: Tables) -> DataFrame:
    return RK.metrics_by_group(saved_pairs(t), "region")


@query("metrics_by_state", f"state:s {METRIC_SPEC}", sql_metrics("state"))
def metrics_by_state(t: Tables) -> DataFrame:
    return RK.metrics_by_group(saved_pairs(t), "state")


FP_ORDER, FN_ORDER = "score DESC, outcome, entity_id, year_t0", "outcome DESC, score DESC, entity_id, year_t0"


@query(
    "fp_fn_topk",
    "kind:s state:s name:s year_t0:l score:d outcome:d",
    f"""SELECT * FROM (SELECT 'false_positive' AS kind, * FROM x_pairs WHERE era = 'completa'
           AND risk_class IN ('ALTO', 'CRITICO') AND outcome < 1 ORDER BY {FP_ORDER} LIMIT 8)
       UNION ALL SELECT * FROM (SELECT 'false_negative' AS kind, * FROM x_pairs WHERE era = 'completa'
           AND risk_class IN ('BAIXO', 'MEDIO') AND outcome > 5 ORDER BY {FN_ORDER} LIMIT 8)""",
)
def fp_fn_topk(t: Tables) -> DataFrame:
    return BT.extreme_errors(saved_pairs(t), 8)


# --- rival grade -------------------------------------------------------------------------

GRADES = {"F1": "A+", "F2": "A", "F3": "B+", "F4": "B", "F5": "C", "O1": "D", "O2": "N.D.", "O3": "N.E.", "O4": "C",
          "O5": "B", "P1": "A", "P2": "C", "P3": "B+", "P4": "D", "P5": "N.D."}
cte("x_grades", f"""
SELECT entity_id, year, state, arg_min({sql_case("(status_code || priority)", GRADES)}, o_orderkey) AS grade
FROM x_owned GROUP BY entity_id, year, state
""")
cte("x_grade_pairs", """
SELECT g.entity_id, g.year, g.state, g.grade, i.year AS year_t1, i.arrears_pct AS outcome, i.arrears_pct > 3e0 AS event
FROM x_grades g JOIN x_indicators i ON i.entity_id = g.entity_id AND i.year = g.year + 1
""")


def grades(t: Tables) -> DataFrame:
    grade = S.choose("concat(status_code, priority)", GRADES)
    rows = S.owned_orders(t).groupBy("entity_id", "year", "state")
    return rows.agg(F.min_by(grade, "o_orderkey").alias("grade")).withColumn("year", F.col("year").cast("bigint"))


def grade_pairs(t: Tables) -> DataFrame:
    return t.shared("grade_pairs", lambda t: G.grade_pairs(grades(t), I.indicators(t)))


@query(
    "grade_pairs",
    "entity_id:l year:l year_t1:l state:s grade:s outcome:d event:b",
    source="x_grade_pairs",
)
def grade_pair_rows(t: Tables) -> DataFrame:
    return grade_pairs(t)


def sql_grade_auc(name: str, risk: dict[str, int]) -> str:
    rows = (f"(SELECT *, {sql_case('grade', risk)} AS risk FROM x_grade_pairs WHERE outcome IS NOT NULL"
            f" AND grade IN ({sql_list(risk)}))")  # fmt: skip
    return (f"SELECT '{name}' AS grade_map, *, {sql_half_even('(n_positives * 100e0 / n_pairs)', 1)} AS event_pct"
            f" FROM ({sql_auc(rows, '', 'risk', 'event', False)})")  # fmt: skip


@query(
    "auc_grade_maps",
    "grade_map:s n_pairs:l n_positives:l event_pct:d auc:d",
    " UNION ALL ".join(sql_grade_auc(name, risk) for name, risk in G.GRADE_MAPS.items()),
)
def auc_grade_maps(t: Tables) -> DataFrame:
    return G.auc_by_grade_map(grade_pairs(t))


def sql_event_rate(section: str, key: str, where: str) -> str:
    return (f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, count(*) AS n_pairs,"
            f" count(*) FILTER (WHERE event) AS events,"
            f" {sql_half_even('(count(*) FILTER (WHERE event) * 100e0 / count(*))', 1)} AS event_pct"
            f" FROM x_grade_pairs WHERE outcome IS NOT NULL AND {where} GROUP BY {key}")  # fmt: skip


VALID_GRADE = f"grade IN ({sql_list(P.GRADE_RISK)})"


@query(
    "grade_benchmark",
    "section:s key:s n_pairs:l events:l event_pct:d",
    " UNION ALL ".join(
        [sql_event_rate(k, k, VALID_GRADE) for k in ("state", "year", "grade")]
        + [sql_event_rate("ungraded", "grade", f"NOT ({VALID_GRADE})")]
    ),
)
def grade_benchmark(t: Tables) -> DataFrame:
    return G.grade_benchmark(grade_pairs(t))


@query(
    "event_rate",
    "region:s n_pairs:l events:l event_pct:d",
    f"""SELECT region, count(*) AS n_pairs, count(*) FILTER (WHERE outcome > 3e0) AS events,
              {sql_half_even("(count(*) FILTER (WHERE outcome > 3e0) * 100e0 / count(*))", 1)} AS event_pct
       FROM x_pairs GROUP BY region""",
)
def event_rate(t: Tables) -> DataFrame:
    rows = saved_pairs(t).withColumn("event", F.col("outcome") > P.CHRONIC_ARREARS_PCT)
    return RK.event_rate(rows, "region")

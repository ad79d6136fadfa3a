"""Cleaning, typing and lookup queries. The dirty text is built from whole source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import shapes as S
from queries.core import Tables, cte, query, sql_case, sql_half_away, sql_list
from riskspark import params as P
from riskspark.functions import dates as D
from riskspark.functions import numbers as N
from riskspark.functions import ratings as R
from riskspark.functions import text as X
from riskspark.operators import dedupe, lookup, reports
from riskspark.operators.accounts import pivot_lines
from riskspark.operators.annual import drop_ghost_rows
from riskspark.plans import staging
from riskspark.sinks.tables import fill_columns


def text_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_custkey").cast("string").alias("cust_text"),
        F.col("o_orderstatus").alias("status_code"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


SQL_PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"


@query(
    "typed_cast",
    "entity_id:l year:l price:d day:dt",
    """SELECT o_custkey AS entity_id, year(o_orderdate) AS year, o_totalprice AS price,
              CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def typed_cast(t: Tables) -> DataFrame:
    raw = text_orders(t).select(
        F.col("cust_text").alias("entity_id"),
        F.year("day").cast("string").alias("year"),
        F.col("price_text").alias("price"),
        F.col("day").cast("string").alias("day"),
    )
    return staging.cast_columns(raw, {"entity_id": "bigint", "year": "bigint", "price": "double", "day": "date"})


@query(
    "cast_via_float",
    "id:l number:l",
    f"""SELECT o_orderkey AS id, CASE {SQL_PRIORITY} WHEN 5 THEN NULL WHEN 4 THEN o_custkey + 1 WHEN 3 THEN o_custkey + 1
              ELSE o_custkey END AS number FROM orders""",
)
def cast_via_float(t: Tables) -> DataFrame:
    """Fractions of .0, .4, .5 and .7, and text that is no number."""
    tail = F.when(F.col("priority") == 4, ".7").when(F.col("priority") == 3, ".5").when(F.col("priority") == 2, ".4")
    text = F.when(F.col("priority") == 5, "x7").otherwise(F.concat("cust_text", F.coalesce(tail, F.lit(".0"))))
    return text_orders(t).select("id", N.cast_via_float(text).alias("number"))


@query(
    "parse_date_multi",
    "id:l parsed:dt",
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders",
)
def parse_date_multi(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("status_code") == "F", F.date_format("day", "yyyy-MM-dd'T'HH:mm"))
        .when(F.col("status_code") == "O", F.date_format("day", "dd/MM/yyyy"))
        .otherwise(F.date_format("day", "MMM yyyy"))
    )
    return text_orders(t).select("id", D.parse_date_multi(text).alias("parsed"))


@query(
    "normalize_code",
    "id:l code:s",
    f"""SELECT o_orderkey AS id, CASE WHEN o_custkey = 53 THEN '{P.FEDERAL_DISTRICT_CODE}'
              WHEN length(CAST(o_custkey AS VARCHAR)) < 7 THEN lpad(CAST(o_custkey AS VARCHAR), 7, '0')
              ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders""",
)
def normalize_code(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("cust_text"), F.when(F.col("priority") > 2, ".0").otherwise(""), F.lit(" "))
    return text_orders(t).select("id", X.normalize_code(text).alias("code"))


@query(
    "rating_stage",
    "state:s entity_id:l year:l edition:l status:s grade:s factor:d percent:d position:l",
    source="x_ratings",
)
def rating_stage(t: Tables) -> DataFrame:
    return staging.stage_ratings(S.raw_ratings(t))


@query(
    "sanitize_columns",
    "data_coleta:dt c_1_1:l regi_o:s col_3:s x:s x_1:d x_1_1:l",
    """SELECT CAST(o_orderdate AS DATE) AS data_coleta, o_orderkey AS c_1_1, o_orderstatus AS regi_o,
              o_orderpriority AS col_3, o_orderstatus AS x, o_totalprice AS x_1, o_custkey AS x_1_1 FROM orders""",
)
def sanitize_columns(t: Tables) -> DataFrame:
    raw = t.orders.select(
        F.col("o_orderdate").cast("date").alias("data coleta"),
        F.col("o_orderkey").alias("1.1"),
        F.col("o_orderstatus").alias("Região"),
        F.col("o_orderpriority").alias("__"),
        F.col("o_orderstatus").alias("_X"),
        F.col("o_totalprice").alias("x"),
        F.col("o_custkey").alias("x_1"),
    )
    return raw.toDF(*X.sanitize_names(raw.columns))


TOKENS = {1: "nan", 2: "None", 3: "NaT", 4: "<NA>"}


@query(
    "null_tokens",
    "id:l token:s doc:s",
    f"""SELECT o_orderkey AS id, CASE WHEN {SQL_PRIORITY} = 5 THEN o_orderstatus END AS token,
              '{{"s":"' || o_orderstatus || '","n":' || {SQL_PRIORITY} || '}}' AS doc FROM orders""",
)
def null_tokens(t: Tables) -> DataFrame:
    token = F.coalesce(S.choose("priority", TOKENS), F.col("status_code"))
    doc = F.to_json(F.struct(F.col("status_code").alias("s"), F.col("priority").alias("n")))
    return text_orders(t).select("id", X.null_tokens(token).alias("token"), X.null_tokens(doc).alias("doc"))


@query(
    "coerce_numeric",
    "id:l whole:l amount:d",
    f"""SELECT o_orderkey AS id, CASE WHEN {SQL_PRIORITY} <> 4 THEN o_custkey END AS whole,
              CASE WHEN {SQL_PRIORITY} <> 2 THEN CAST(round(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
                || '1234567895' AS DECIMAL(38,18)), 9) AS DOUBLE) END AS amount FROM orders""",
)
def coerce_numeric(t: Tables) -> DataFrame:
    whole = F.when(F.col("priority") == 4, "??").otherwise(F.col("cust_text"))
    point = F.concat(F.col("price").cast("decimal(18,2)").cast("string"), F.lit("1234567895"))
    amount = F.when(F.col("priority") == 2, " ").when(F.col("priority") == 3, point)
    amount = amount.otherwise(F.replace(point, F.lit("."), F.lit(",")))
    return text_orders(t).select(
        "id", N.parse_int(whole).alias("whole"), N.parse_decimal9(amount).cast("double").alias("amount")
    )


BOOL_TEXT = {
    "F1": "true", "F2": "1", "F3": "T", "F4": "yes", "F5": " Y ",
    "O1": "Sim", "O2": "FALSE", "O3": "0", "O4": "f", "O5": "No",
    "P1": "N", "P2": "nao", "P3": "Não", "P4": "talvez",
}
BOOL_VALUE = {k: int(v.strip().lower() not in P.FALSE_TOKENS) for k, v in BOOL_TEXT.items()}


@query(
    "parse_bool",
    "id:l flag:b",
    f"""SELECT o_orderkey AS id, CAST({sql_case(f"(o_orderstatus || {SQL_PRIORITY})", BOOL_VALUE)} AS BOOLEAN) AS flag
        FROM orders""",
)
def parse_bool(t: Tables) -> DataFrame:
    return text_orders(t).select("id", N.parse_bool(S.choose("concat(status_code, priority)", BOOL_TEXT)).alias("flag"))


@query(
    "decimal_comma",
    "id:l amount:d share:d",
    f"""SELECT o_orderkey AS id, CASE WHEN {SQL_PRIORITY} <> 5 THEN o_totalprice END AS amount,
              CASE WHEN {SQL_PRIORITY} = 5 THEN NULL WHEN o_totalprice / 5000e0 > 1.5e0 THEN
                CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) / 100e0 ELSE o_totalprice END AS share FROM orders""",
)
def decimal_comma(t: Tables) -> DataFrame:
    comma = F.translate(F.format_number("price", 2), ",.", ".,")
    text = F.when(F.col("priority") == 5, "N/A").when(F.col("priority") == 1, F.col("price_text")).otherwise(comma)
    amount = N.parse_decimal_comma(text)
    scaled = F.when(F.col("price") / 5000.0 > 1.5, amount)
    share = F.when(scaled.isNotNull(), N.percent_to_unit(scaled)).otherwise(amount)
    return text_orders(t).select("id", amount.alias("amount"), share.alias("share"))


@query(
    "fill_defaults",
    "entity_id:s score:d factor:d stale:b missing:b note:s",
    "SELECT entity_id, score, 0.8e0 AS factor, FALSE AS stale, TRUE AS missing, NULL AS note FROM x_snapshots",
)
def fill_defaults(t: Tables) -> DataFrame:
    defaults = {
        "score": ("double", 0.0),
        "factor": ("double", P.NO_RATING_FACTOR),
        "stale": ("boolean", False),
        "missing": ("boolean", True),
        "note": ("string", None),
    }
    return fill_columns(S.snapshots(t), defaults, ["entity_id", *defaults])


FOLD_PREFIX = "  Município\t de   ÁGUA Branca – São João ñ ç ü "


@query(
    "fold_text",
    "entity_id:l folded:s key:s",
    """SELECT c_custkey AS entity_id, 'municipio de agua branca – sao joao n c u ' || lower(c_name) AS folded,
              'municipiodeaguabrancasaojoaoncu' || regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS key
       FROM customer""",
)
def fold_text(t: Tables) -> DataFrame:
    text = F.concat(F.lit(FOLD_PREFIX), F.col("c_name"))
    return t.customer.select(
        F.col("c_custkey").alias("entity_id"), X.fold_text(text).alias("folded"), X.normalize_key(text).alias("key")
    )


@query(
    "strip_suffix",
    "entity_id:l name:s",
    "SELECT entity_id, name FROM x_dim",
)
def strip_suffix(t: Tables) -> DataFrame:
    tagged = F.concat("name", F.lit("  - "), F.col("state"))
    return S.dim(t).select("entity_id", X.strip_suffix(tagged).alias("name"))


@query(
    "drop_ghost_rows",
    "entity_id:l year:l period:l revenue_realized:d revenue_planned:d",
    """SELECT * FROM (
         SELECT entity_id, year, period,
                MAX(CASE WHEN column_label LIKE 'At_ o Bimestre%' THEN value END) AS revenue_realized,
                MAX(CASE WHEN column_label LIKE 'PREVIS_O%' THEN value END) AS revenue_planned
         FROM x_budget_lines GROUP BY entity_id, year, period)
       WHERE revenue_realized IS NOT NULL OR revenue_planned IS NOT NULL""",
)
def ghost_rows(t: Tables) -> DataFrame:
    rules = {k: P.BUDGET_RULES[k] for k in ("revenue_realized", "revenue_planned")}
    wide = pivot_lines(S.budget_lines(t), ["entity_id", "year", "period"], rules)
    return drop_ghost_rows(wide, list(rules))


@query(
    "flatten_json",
    "contract_id:s updated:s entity_id:l entity_name:s unit_state:s unit_name:s body_tax_id:s body_name:s",
    """SELECT contract_id, strftime(updated, '%Y-%m-%d') || 'T' || lpad(CAST(version AS VARCHAR), 12, '0') AS updated,
              entity_id, entity_name, unit_state, unit_name, body_tax_id, body_name FROM x_raw_contracts""",
)
def flatten_json(t: Tables) -> DataFrame:
    return staging.flatten_json(S.raw_contracts(t))


@query(
    "contracts_stage",
    "contract_id:s state:s purchase_year:l month:l modality:l entity_id:l entity_name:s unit_name:s body_tax_id:s"
    " estimated_value:d awarded_value:d published:dt updated:dt",
    source="x_contracts",
)
def contracts_stage(t: Tables) -> DataFrame:
    return staging.stage_contracts(S.raw_contracts(t))


@query(
    "block_fields",
    "contract_id:s state:s month:l updated:s collector_mode:s",
    """SELECT contract_id, CASE WHEN no_data IS NOT NULL THEN state ELSE 'PB' END AS state, month,
              strftime(updated, '%Y-%m-%d') AS updated, 'full' AS collector_mode FROM x_raw_contracts""",
)
def block_fields(t: Tables) -> DataFrame:
    raw = S.raw_contracts(t)
    tagged = raw.select(
        "contract_id",
        F.when(F.col("no_data").isNotNull(), F.col("state")).alias("block_state"),
        F.substring("published", 1, 7).alias("block_month"),
        "published",
        F.substring("updated", 1, 10).alias("updated_alias"),
    )
    return staging.derive_block_fields(tagged, "pb", {"collector_mode": "full"})


@query(
    "region_lookup",
    "entity_id:l state:s region:s",
    f"SELECT entity_id, state, {sql_case('state', P.STATE_REGION)} AS region FROM x_dim",
)
def region_lookup(t: Tables) -> DataFrame:
    return lookup.region_lookup(S.dim(t))


PREFIXES = list(P.CODE_PREFIX_STATE)[:25]


@query(
    "state_from_code",
    "code:s code_state:s",
    f"""SELECT prefix || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code,
              {sql_case("prefix", P.CODE_PREFIX_STATE)} AS code_state
        FROM (SELECT c_custkey, list_extract([{sql_list(PREFIXES)}], c_nationkey + 1) AS prefix FROM customer)""",
)
def state_from_code(t: Tables) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), F.col("c_nationkey") + 1)
    codes = t.customer.select(F.concat(prefix, F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("code"))
    return lookup.state_from_code(codes, "code")


@query(
    "override_entity",
    "entity_id:l n_lines:l population:l",
    f"""SELECT CASE entity_id WHEN 53 THEN {P.FEDERAL_DISTRICT_CODE} ELSE entity_id END AS entity_id,
              count(*) AS n_lines, max(CASE entity_id WHEN 53 THEN 3000000 ELSE population END) AS population
        FROM x_budget_lines WHERE entity_id <> 54 GROUP BY 1""",
)
def override_entity(t: Tables) -> DataFrame:
    rows = [
        (int(P.FEDERAL_DISTRICT_QUERY_ID), int(P.FEDERAL_DISTRICT_CODE), "Prefeitura Customer#000000053", 3_000_000),
        (54, 54, P.FEDERAL_DISTRICT_INSTITUTION, None),
    ]
    schema = "query_id bigint, output_id bigint, institution_only string, output_population bigint"
    overrides = t.spark.createDataFrame(rows, schema)
    lines = lookup.override_entity(S.budget_lines(t), F.broadcast(overrides))
    return lines.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("population").alias("population")
    )


@query(
    "semi_state",
    "entity_id:l n_lines:l",
    """SELECT entity_id, count(*) AS n_lines FROM x_budget_lines
       WHERE entity_id IN (SELECT entity_id FROM x_dim WHERE state IN ('AC', 'BA', 'PB')) GROUP BY entity_id""",
)
def semi_state(t: Tables) -> DataFrame:
    counts = S.budget_lines(t).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return lookup.of_state(counts, S.dim(t), ["AC", "BA", "PB"])


@query(
    "rating_from_percent",
    "entity_id:l year:l percent:d grade:s factor:d text_grade:s",
    f"""SELECT entity_id, year, percent, grade, {S.SQL_FACTOR.format(g="grade")} AS factor,
              CASE WHEN status = 'FINAL' THEN 'B' ELSE grade END AS text_grade FROM x_raw_ratings""",
)
def rating_from_percent(t: Tables) -> DataFrame:
    rows = S.raw_ratings(t)
    grade = R.grade_from_percent(F.col("percent"))
    label = F.when(F.col("status") == P.STATUS_FINAL, " b - bom").otherwise("sem")
    return rows.select(
        F.col("entity_code").cast("bigint").alias("entity_id"),
        F.col("year").cast("bigint").alias("year"),
        "percent",
        grade.alias("grade"),
        R.grade_factor(grade).alias("factor"),
        R.grade_from_text(label, F.col("percent")).alias("text_grade"),
    )


DELIVERY_NAMES = {
    "F1": "Relatório Resumido de Execução Orçamentária",
    "F2": "Relatório Resumido de Execução Orçamentária Simplificado",
    "F3": "RREO", "F4": "RREO  Simplificado", "F5": "rreo simplificado 2",
    "O1": "Relatório de Gestão Fiscal", "O2": "Relatório de Gestão Fiscal Simplificado",
    "O3": "RGF", "O4": "Rgf Simplificado", "O5": "RGF e RREO",
    "P1": "Balanço Anual (DCA)", "P2": "", "P3": "MSC", "P4": "Extrato RGF 1", "P5": "Anexo",
}
BUDGET_KIND = {"F1": "RREO", "F2": "RREO Simplificado", "F3": "RREO", "F4": "RREO Simplificado",
               "F5": "RREO Simplificado", "O5": "RREO"}
FISCAL_KIND = {"O1": "RGF", "O2": "RGF Simplificado", "O3": "RGF", "O4": "RGF Simplificado", "O5": "RGF", "P4": "RGF"}


@query(
    "deliverable_kind",
    "id:l budget_kind:s fiscal_kind:s",
    f"""SELECT o_orderkey AS id, {sql_case(f"(o_orderstatus || {SQL_PRIORITY})", BUDGET_KIND)} AS budget_kind,
              {sql_case(f"(o_orderstatus || {SQL_PRIORITY})", FISCAL_KIND)} AS fiscal_kind FROM orders""",
)
def deliverable_kind(t: Tables) -> DataFrame:
    named = text_orders(t).withColumn("deliverable", S.choose("concat(status_code, priority)", DELIVERY_NAMES))
    return reports.deliverable_kinds(named)


@query(
    "dedupe_latest",
    "entity_id:l order_id:l day:dt price:d",
    """SELECT entity_id, order_id, day, price FROM (
         SELECT o_custkey AS entity_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def dedupe_latest(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("price"),
    )
    return dedupe.dedupe_latest(rows, ["entity_id"], ["day"])


cte("x_budget_staged", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, year, period, annex, account_code, column_label, account_name,
           sphere ORDER BY value DESC NULLS LAST) AS rn FROM x_budget_lines) WHERE rn = 1
""")
cte("x_fiscal_staged", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, year, period, regime, annex, account_code, column_label,
           account_name, sphere ORDER BY value DESC NULLS LAST) AS rn FROM x_fiscal_lines) WHERE rn = 1
""")
LINE_COLUMNS = "entity_id:l state:s year:l period:l annex:s account_code:s column_label:s account_name:s value:d"


@query("dedupe_wide_key", LINE_COLUMNS, source="x_budget_staged")
def dedupe_wide_key(t: Tables) -> DataFrame:
    return staging.stage_budget_lines(S.budget_lines(t))


@query("dedupe_regime_key", LINE_COLUMNS + " regime:s", source="x_fiscal_staged")
def dedupe_regime_key(t: Tables) -> DataFrame:
    return staging.stage_fiscal_lines(S.fiscal_lines(t))


@query(
    "dedupe_keep_last",
    "entity_id:l year:l price:d seq:l",
    """SELECT entity_id, year, price, seq FROM (
         SELECT entity_id, year, price, o_orderkey AS seq,
                row_number() OVER (PARTITION BY entity_id, year ORDER BY o_orderkey DESC) AS rn FROM x_owned) WHERE rn = 1""",
)
def dedupe_keep_last(t: Tables) -> DataFrame:
    rows = S.owned_orders(t).select("entity_id", "year", "price", F.col("o_orderkey").alias("seq"))
    return dedupe.dedupe_keep_last(rows, ["entity_id", "year"], "seq")


@query(
    "dim_stage",
    "entity_id:l state:s name:s population:l",
    source="x_dim",
)
def dim_stage(t: Tables) -> DataFrame:
    texts = [F.col(c).cast("string").alias(c) for c in S.dim(t).columns]
    doubled = S.dim(t).select(*texts).unionByName(S.dim(t).select(*texts))
    return staging.stage_dim(doubled)


@query(
    "accounts_stage",
    "entity_id:l state:s year:l tax_revenue:d current_revenue:d financial_assets:d financial_liabilities:d"
    " balance_available:b revenue_available:b population:l",
    source="x_accounts",
)
def accounts_stage(t: Tables) -> DataFrame:
    return staging.stage_accounts(S.raw_accounts(t))


@query(
    "flags_stage",
    "entity_id:l collected:dt surveyed:dt req_cadin:s req_tcu:s req_siconfi_mcasp:s",
    source="x_flags",
)
def flags_stage(t: Tables) -> DataFrame:
    return staging.stage_flags(S.raw_flags(t))


PRELIMINARY_CHECKS = ["v1", "v2", "v3", "v4"]


@query(
    "row_mean",
    "id:l percent:d grade:s factor:d",
    f"""SELECT id, percent, grade, {S.SQL_FACTOR.format(g="grade")} AS factor FROM (
          SELECT *, {S.SQL_GRADE.format(p="percent")} AS grade FROM (
            SELECT id, CASE WHEN n > 0 THEN (round_even(((0e0 + coalesce(v1, 0e0) + coalesce(v2, 0e0) + coalesce(v3, 0e0)
                     + coalesce(v4, 0e0)) / n) * 1e6, 0) / 1e6 + 0e0) END AS percent FROM (
              SELECT *, (v1 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT + (v3 IS NOT NULL)::INT + (v4 IS NOT NULL)::INT AS n
              FROM (
                SELECT o_orderkey AS id,
                       CASE WHEN {SQL_PRIORITY} IN (1, 2, 3) THEN {sql_half_away("(o_totalprice / 500000e0)", 4)} END AS v1,
                       CASE WHEN {SQL_PRIORITY} IN (1, 2) THEN 1e0 END AS v2,
                       CASE WHEN {SQL_PRIORITY} IN (1, 4) THEN 0.5e0 END AS v3,
                       CASE WHEN {SQL_PRIORITY} <> 5 AND o_orderstatus = 'F' THEN 0.9e0 END AS v4 FROM orders))))""",
)
def row_mean(t: Tables) -> DataFrame:
    p = F.col("priority")
    share = F.format_number(N.half_away(F.col("price") / 500000.0, 4), 4)
    rows = text_orders(t).select(
        "id",
        F.when(p.isin(1, 2, 3), F.replace(share, F.lit("."), F.lit(","))).otherwise("-").alias("v1"),
        F.when(p.isin(1, 2), "1").otherwise("").alias("v2"),
        F.when(p.isin(1, 4), "0,5").otherwise("NA").alias("v3"),
        F.when((p != 5) & (F.col("status_code") == "F"), "0.9").alias("v4"),
    )
    return reports.preliminary_rating(rows, PRELIMINARY_CHECKS)


@query(
    "month_spine",
    "contract_id:s month_start:dt month_end:dt",
    """SELECT contract_id, greatest(m, start_day) AS month_start,
              least(last_day(m), end_day) AS month_end
       FROM (SELECT contract_id, start_day, end_day, CAST(unnest(generate_series(date_trunc('month', start_day),
                    CAST(end_day AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m
             FROM (SELECT contract_id, max(published) AS end_day,
                          CAST(max(published) - INTERVAL 6 MONTH AS DATE) AS start_day
                   FROM x_raw_contracts GROUP BY contract_id))""",
)
def month_spine(t: Tables) -> DataFrame:
    last = S.raw_contracts(t).groupBy("contract_id").agg(F.max(F.to_date(F.substring("published", 1, 10))).alias("end_day"))
    spans = last.withColumn("start_day", D.months_back(F.col("end_day"), 6))
    return D.month_spine(spans, "start_day", "end_day")

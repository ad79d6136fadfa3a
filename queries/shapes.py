"""Test tables in the shape of the engine's inputs, in Spark and in SQL.

Every shape covers its whole source tables. Entities are customers, fiscal lines are line
items, ratings / accounts / contracts / flags come from orders, snapshots from events.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.core import Tables, cte, sql_case, sql_half_away, sql_list
from riskspark import params as P
from riskspark.functions.numbers import half_away
from riskspark.functions.ratings import class_label, grade_factor, grade_from_percent
from riskspark.operators.dedupe import dedupe_latest, keep_first
from riskspark.plans import staging
from riskspark.plans.postprocess import Window
from riskspark.session import written

AS_OF = date(2001, 11, 30)
CONTRACTS_AS_OF = date(2001, 8, 1)
WINDOW = Window(AS_OF, 1996)
FIRST_YEAR, LAST_YEAR = 1996, 2001
STATES = sorted(P.STATE_REGION)[:25]
SQL_STATES = f"[{sql_list(STATES)}]"


def state_at(index) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), index.cast("int") + 1)


def choose(key: str, mapping: dict) -> F.Column:
    """CASE over an SQL key expression; one call however long the mapping."""

    def literal(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)

    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return F.expr(f"CASE {key} {whens} END")


# --- entities ----------------------------------------------------------------------------


def entities(t: Tables) -> DataFrame:
    """All entities that report; some of them the dimension does not know."""

    def build(t: Tables) -> DataFrame:
        joined = t.customer.join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("entity_id"),
            state_at(F.col("n_nationkey")).alias("state"),
            F.col("c_name").alias("name"),
            F.floor(F.abs("c_acctbal") * 30.0).cast("bigint").alias("population"),
            (F.col("c_acctbal") < OUTSIDE_BELOW).alias("outside"),
        )

    return t.shared("entities", build)


def dim(t: Tables) -> DataFrame:
    return t.shared("dim", lambda t: entities(t).filter("NOT outside").drop("outside"))


# customers in the deepest debt report without being in the dimension
OUTSIDE_BELOW = -800.0
cte("x_entities", f"""
SELECT c_custkey AS entity_id, list_extract({SQL_STATES}, n_nationkey + 1) AS state, c_name AS name,
       CAST(floor(abs(c_acctbal) * 30e0) AS BIGINT) AS population, c_acctbal < {OUTSIDE_BELOW}e0 AS outside
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
cte("x_dim", "SELECT entity_id, state, name, population FROM x_entities WHERE NOT outside")


def joined_orders(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderstatus").alias("status_code"),
        F.col("o_totalprice").alias("price"),
        day.alias("day"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )
    return rows.join(entities(t).drop("outside"), "entity_id")


def owned_orders(t: Tables) -> DataFrame:
    """Orders with the entity attributes and calendar parts every other shape uses."""
    return t.shared("owned_orders", joined_orders)


def write_orders(t: Tables) -> None:
    """Joins the owned orders once, for a job that builds many tables from them; call before any of these."""
    t.shared("owned_orders", lambda t: written(joined_orders(t), "owned-orders"))


cte("x_owned", """
SELECT o.o_orderkey, o.o_custkey AS entity_id, o.o_orderstatus AS status_code, o.o_totalprice AS price,
       CAST(o.o_orderdate AS DATE) AS day, year(o.o_orderdate) AS year, month(o.o_orderdate) AS month,
       CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS priority, d.state, d.name, d.population
FROM orders o JOIN x_entities d ON d.entity_id = o.o_custkey
""")

# --- account lines -----------------------------------------------------------------------

NO_ARREARS_STATE = STATES[24]  # reports no arrears, so none of its entities has a valid year
BUDGET_ANNEX = {1: "RREO-Anexo 01", 2: "RREO-Anexo 01", 3: "RREO-Anexo 01", 4: "RREO-Anexo 07",
                5: "RREO-Anexo 07", 6: "RREO-Anexo 02", 7: "RREO-Anexo 07"}
BUDGET_CODE = {1: "ReceitasExcetoIntraOrcamentarias", 2: "ReceitasExcetoIntraOrcamentarias", 3: "TotalDespesas",
               4: "RestosAPagarNaoProcessadosAPagar",
               5: "RestosAPagarProcessadosENaoProcessadosLiquidadosAPagar",
               7: "RestosAPagarProcessadosENaoProcessadosLiquidadosAPagarIntra"}
BUDGET_COLUMN = {1: "Até o Bimestre (c)", 2: "PREVISÃO ATUALIZADA (a)", 3: "DESPESAS LIQUIDADAS ATÉ O BIMESTRE (h)",
                 4: "Saldo k = (f + g) - (i + j)", 5: "Saldo e = (a+ b) - (c + d)", 6: "Valor",
                 7: "Saldo e = (a + b) - (c + d)"}
BUDGET_NAME = {1: "RECEITAS", 2: "RECEITAS", 3: "DESPESAS", 4: "TOTAL (III) = (I + II)", 5: "TOTAL (III) = (I + II)",
               6: "OUTRAS", 7: "TOTAL (III) = (I + II)"}
# value = offset + slope * price
BUDGET_VALUE = {1: (40000.0, 0.3), 2: (45000.0, 0.25), 3: (30000.0, 0.4), 4: (0.0, 0.05), 5: (0.0, 0.04),
                6: (0.0, 1.0), 7: (0.0, 0.03)}
FISCAL_CODE = {1: P.CASH_AFTER, 2: P.CASH_AFTER, 3: P.CASH_AFTER, 4: P.CASH_BEFORE, 5: P.CASH_BEFORE,
               6: P.CASH_BEFORE, 7: "Outros"}
FISCAL_NAME = {1: "TOTAL (IV) = (I + II + III)", 2: "TOTAL (III) = (I + II)",
               3: "TOTAL DOS RECURSOS VINCULADOS AO RPPS (III)", 4: "TOTAL (IV) = (I + II + III)",
               5: "TOTAL (III) = (I + II)", 6: "TOTAL DOS RECURSOS VINCULADOS AO RPPS (III)", 7: "Outros"}
FISCAL_VALUE = {1: (-35000.0, 0.7), 2: (-30000.0, 0.6), 3: (0.0, 0.05), 4: (-25000.0, 0.6), 5: (-20000.0, 0.5),
                6: (0.0, 0.04), 7: (0.0, 1.0)}


def line_value(values: dict) -> F.Column:
    offset = choose("line", {k: v[0] for k, v in values.items()})
    slope = choose("line", {k: v[1] for k, v in values.items()})
    return half_away(offset + slope * F.col("l_extendedprice"), 2)


def sql_line_value(values: dict) -> str:
    offset = sql_case("line", {k: v[0] for k, v in values.items()})
    slope = sql_case("line", {k: v[1] for k, v in values.items()})
    return sql_half_away(f"({offset} + {slope} * l_extendedprice)", 2)


def order_lines(t: Tables) -> DataFrame:
    def build(t: Tables) -> DataFrame:
        items = t.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_linenumber").alias("line"),
            "l_returnflag",
            "l_linestatus",
            "l_extendedprice",
            "l_partkey",
            "l_suppkey",
        )
        return items.join(owned_orders(t), "o_orderkey")

    return t.shared("order_lines", build)


cte("x_order_lines", """
SELECT w.*, l.l_linenumber AS line, l.l_returnflag, l.l_linestatus, l.l_extendedprice, l.l_partkey, l.l_suppkey
FROM lineitem l JOIN x_owned w ON w.o_orderkey = l.l_orderkey
""")


def budget_lines(t: Tables) -> DataFrame:
    """Typed but not de-duplicated budget lines."""

    def build(t: Tables) -> DataFrame:
        line = F.col("line")
        other = F.when(F.col("l_returnflag") != "A", F.lit("OutrasReceitas"))
        annex = choose("line", BUDGET_ANNEX)
        return order_lines(t).select(
            "entity_id",
            "state",
            F.concat(F.lit("Prefeitura "), F.col("name")).alias("institution"),
            F.col("year").cast("bigint").alias("year"),
            F.ceil(F.col("month") / 2.0).cast("int").alias("period"),
            F.lit("B").alias("regime"),
            F.when(F.col("l_returnflag") == "R", F.concat(annex, F.lit(" - BO"))).otherwise(annex).alias("annex"),
            F.lit("M").alias("sphere"),
            choose("line", BUDGET_COLUMN).alias("column_label"),
            F.when(line == 6, other)
            .when((F.col("state") == NO_ARREARS_STATE) & line.isin(5, 7), None)
            .otherwise(choose("line", BUDGET_CODE))
            .alias("account_code"),
            choose("line", BUDGET_NAME).alias("account_name"),
            line_value(BUDGET_VALUE).alias("value"),
            "population",
        )

    return t.shared("budget_lines", build)


cte("x_budget_lines", f"""
SELECT entity_id, state, 'Prefeitura ' || name AS institution, year, CAST(ceil(month / 2e0) AS INTEGER) AS period,
       'B' AS regime,
       {sql_case("line", BUDGET_ANNEX)} || CASE WHEN l_returnflag = 'R' THEN ' - BO' ELSE '' END AS annex,
       'M' AS sphere, {sql_case("line", BUDGET_COLUMN)} AS column_label,
       CASE WHEN line = 6 THEN CASE WHEN l_returnflag <> 'A' THEN 'OutrasReceitas' END
            WHEN state = '{NO_ARREARS_STATE}' AND line IN (5, 7) THEN NULL ELSE {sql_case("line", BUDGET_CODE)} END AS account_code,
       {sql_case("line", BUDGET_NAME)} AS account_name, {sql_line_value(BUDGET_VALUE)} AS value, population
FROM x_order_lines
""")


def fiscal_lines(t: Tables) -> DataFrame:
    def build(t: Tables) -> DataFrame:
        line = F.col("line")
        quarterly = F.col("l_linestatus") == "O"
        annex = F.when(line == 7, F.lit("RGF-Anexo 01")).otherwise(P.FISCAL_ANNEX)
        return order_lines(t).select(
            "entity_id",
            "state",
            F.concat(F.lit("Prefeitura "), F.col("name")).alias("institution"),
            F.col("year").cast("bigint").alias("year"),
            F.when(quarterly, F.ceil(F.col("month") / 4.0))
            .otherwise(F.ceil(F.col("month") / 6.0))
            .cast("int")
            .alias("period"),
            F.when(quarterly, "Q").otherwise("S").alias("regime"),
            F.when(F.col("l_returnflag") == "R", F.concat(annex, F.lit(" (Consolidado)"))).otherwise(annex).alias("annex"),
            F.lit("M").alias("sphere"),
            F.lit("Valor").alias("column_label"),
            choose("line", FISCAL_CODE).alias("account_code"),
            choose("line", FISCAL_NAME).alias("account_name"),
            line_value(FISCAL_VALUE).alias("value"),
            "population",
        )

    return t.shared("fiscal_lines", build)


cte("x_fiscal_lines", f"""
SELECT entity_id, state, 'Prefeitura ' || name AS institution, year,
       CAST(CASE WHEN l_linestatus = 'O' THEN ceil(month / 4e0) ELSE ceil(month / 6e0) END AS INTEGER) AS period,
       CASE WHEN l_linestatus = 'O' THEN 'Q' ELSE 'S' END AS regime,
       CASE WHEN line = 7 THEN 'RGF-Anexo 01' ELSE '{P.FISCAL_ANNEX}' END
         || CASE WHEN l_returnflag = 'R' THEN ' (Consolidado)' ELSE '' END AS annex,
       'M' AS sphere, 'Valor' AS column_label, {sql_case("line", FISCAL_CODE)} AS account_code,
       {sql_case("line", FISCAL_NAME)} AS account_name, {sql_line_value(FISCAL_VALUE)} AS value, population
FROM x_order_lines
""")

# --- ratings -----------------------------------------------------------------------------

STATUS = {"F": P.STATUS_FINAL, "P": P.STATUS_PRELIMINARY, "O": "RASCUNHO"}


def raw_ratings(t: Tables) -> DataFrame:
    """Text-typed ratings; some refer to the year before or after the order's."""

    def build(t: Tables) -> DataFrame:
        shift = F.when(F.col("priority") == 1, -1).when(F.col("priority") == 5, 1).otherwise(0)
        percent = half_away(F.lit(0.55) + F.col("price") / 500000.0 * 0.45, 4)
        grade = grade_from_percent(percent)
        return owned_orders(t).select(
            F.concat(F.lit(" "), F.lower("state")).alias("state"),
            F.col("entity_id").cast("string").alias("entity_code"),
            (F.col("year") + shift).cast("string").alias("year"),
            (F.col("year") + shift + 1).cast("string").alias("edition"),
            choose("status_code", STATUS).alias("status"),
            F.concat(F.lower(grade), F.lit(" ")).alias("grade"),
            grade_factor(grade).alias("factor"),
            percent.alias("percent"),
            F.when(F.col("priority") == 3, "n/d").otherwise(F.col("o_orderkey").cast("string")).alias("position"),
        )

    return t.shared("raw_ratings", build)


SQL_GRADE = ("CASE WHEN {p} IS NULL THEN 'SEM_ICF' WHEN {p} >= 0.95e0 THEN 'A' WHEN {p} >= 0.85e0 THEN 'B' "
             "WHEN {p} >= 0.75e0 THEN 'C' WHEN {p} >= 0.65e0 THEN 'D' ELSE 'E' END")  # fmt: skip
SQL_FACTOR = "CASE {g} WHEN 'A' THEN 1.0e0 WHEN 'B' THEN 0.95e0 WHEN 'C' THEN 0.9e0 WHEN 'D' THEN 0.85e0 ELSE 0.8e0 END"
cte("x_raw_ratings", f"""
SELECT state, entity_id, year + CASE priority WHEN 1 THEN -1 WHEN 5 THEN 1 ELSE 0 END AS year,
       year + CASE priority WHEN 1 THEN -1 WHEN 5 THEN 1 ELSE 0 END + 1 AS edition,
       {sql_case("status_code", STATUS)} AS status, {SQL_GRADE.format(p="percent")} AS grade,
       {SQL_FACTOR.format(g="(" + SQL_GRADE.format(p="percent") + ")")} AS factor, percent,
       CASE WHEN priority <> 3 THEN o_orderkey END AS position
FROM (SELECT *, {sql_half_away("(0.55e0 + price / 500000e0 * 0.45e0)", 4)} AS percent FROM x_owned)
""")


def ratings(t: Tables) -> DataFrame:
    """The same ratings as already typed columns, one per (entity, year)."""

    def build(t: Tables) -> DataFrame:
        shift = F.when(F.col("priority") == 1, -1).when(F.col("priority") == 5, 1).otherwise(0)
        rows = owned_orders(t).select(
            "state",
            "entity_id",
            (F.col("year") + shift).cast("bigint").alias("year"),
            choose("status_code", STATUS).alias("status"),
            half_away(F.lit(0.55) + F.col("price") / 500000.0 * 0.45, 4).alias("percent"),
            F.when(F.col("priority") != 3, F.col("o_orderkey")).alias("position"),
        )
        rows = rows.withColumn("edition", F.col("year") + 1).withColumn("grade", grade_from_percent(F.col("percent")))
        return staging.newest_ratings(rows.withColumn("factor", grade_factor(F.col("grade"))))

    return t.shared("ratings", build)


cte("x_ratings", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, year ORDER BY
           CASE status WHEN 'FINAL' THEN 1 WHEN 'PREVIO_OFICIAL' THEN 2 ELSE 9 END,
           percent DESC NULLS LAST, grade DESC NULLS LAST, factor DESC NULLS LAST, edition DESC NULLS LAST,
           position DESC NULLS LAST) AS rn
  FROM x_raw_ratings) WHERE rn = 1
""")

# --- annual accounts ---------------------------------------------------------------------


def raw_accounts(t: Tables) -> DataFrame:
    def build(t: Tables) -> DataFrame:
        price = F.col("price")
        missing = (F.col("status_code") == "P") & (F.col("priority") == 5)
        return owned_orders(t).select(
            F.col("entity_id").cast("string").alias("entity_id"),
            "state",
            F.col("year").cast("string").alias("year"),
            half_away(price * (0.02 + 0.01 * F.col("priority")), 2).alias("tax_revenue"),
            F.when(~missing, price).alias("current_revenue"),
            half_away(price * 0.4, 2).alias("financial_assets"),
            half_away(price * 0.25 + 20000.0, 2).alias("financial_liabilities"),
            F.when(F.col("status_code") == "F", "True").otherwise("False").alias("balance_available"),
            F.when(missing, "nao").otherwise("sim").alias("revenue_available"),
            F.col("population").cast("string").alias("population"),
        )

    return t.shared("raw_accounts", build)


cte("x_raw_accounts", f"""
SELECT entity_id, state, year, {sql_half_away("(price * (0.02e0 + 0.01e0 * priority))", 2)} AS tax_revenue,
       CASE WHEN NOT (status_code = 'P' AND priority = 5) THEN price END AS current_revenue,
       {sql_half_away("(price * 0.4e0)", 2)} AS financial_assets,
       {sql_half_away("(price * 0.25e0 + 20000e0)", 2)} AS financial_liabilities,
       status_code = 'F' AS balance_available, NOT (status_code = 'P' AND priority = 5) AS revenue_available, population
FROM x_owned
""")


def accounts(t: Tables) -> DataFrame:
    """The same accounts as already typed columns, one per (entity, year)."""

    def build(t: Tables) -> DataFrame:
        price = F.col("price")
        missing = (F.col("status_code") == "P") & (F.col("priority") == 5)
        rows = owned_orders(t).select(
            "entity_id",
            "state",
            F.col("year").cast("bigint").alias("year"),
            half_away(price * (0.02 + 0.01 * F.col("priority")), 2).alias("tax_revenue"),
            F.when(~missing, price).alias("current_revenue"),
            half_away(price * 0.4, 2).alias("financial_assets"),
            half_away(price * 0.25 + 20000.0, 2).alias("financial_liabilities"),
            (F.col("status_code") == "F").alias("balance_available"),
            (~missing).alias("revenue_available"),
            "population",
        )
        return dedupe_latest(rows, ["entity_id", "year"], [])

    return t.shared("accounts", build)


cte("x_accounts", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, year ORDER BY state NULLS LAST, tax_revenue NULLS LAST,
           current_revenue NULLS LAST, financial_assets NULLS LAST, financial_liabilities NULLS LAST,
           balance_available NULLS LAST, revenue_available NULLS LAST, population NULLS LAST) AS rn
  FROM x_raw_accounts) WHERE rn = 1
""")

# --- compliance flags --------------------------------------------------------------------


# requirement watched by each (month, priority): at most one, since 12 and 5 share no factor
WATCHED = {(j % 12 + 1) * 10 + j % 5 + 1: j for j in range(len(P.REQUIREMENTS))}


def flag_masks(t: Tables) -> DataFrame:
    """Per (entity, year): bit sets of the requirements hit by orders of either kind."""

    def build(t: Tables) -> DataFrame:
        rows = owned_orders(t).withColumn("slot", choose("month * 10 + priority", WATCHED))
        return rows.groupBy("entity_id", "year").agg(
            F.expr("coalesce(bit_or(CASE WHEN status_code = 'F' THEN 1L << slot END), 0L)").alias("marked"),
            F.expr("coalesce(bit_or(CASE WHEN status_code <> 'F' THEN 1L << slot END), 0L)").alias("blank"),
            F.count_if(F.col("status_code") == "P").alias("n_p"),
        )

    return t.shared("flag_masks", build)


def flag_values() -> list[str]:
    values = [
        f"CASE WHEN (marked >> {j}) & 1 = 1 THEN '!' WHEN (blank >> {j}) & 1 = 1 THEN ' ' ELSE concat(year, '-12-31') END"
        for j in range(len(P.REQUIREMENTS))
    ]
    values[27] = f"CASE WHEN n_p = 0 THEN {values[27]} END"
    return [f"{value} AS {column}" for value, column in zip(values, P.REQUIREMENT_COLUMNS)]


def raw_flags(t: Tables) -> DataFrame:
    """One wide all-text row per (entity, year)."""
    return flag_masks(t).selectExpr(
        "cast(entity_id AS string) AS entity_id",
        *flag_values(),
        "concat('31/12/', year) AS surveyed",
        "concat(year, '-12-31T10:00') AS collected",
    )


def flags(t: Tables) -> DataFrame:
    """The newest flag row per entity with typed key."""
    newest = keep_first(flag_masks(t), ["entity_id"], [F.col("year").desc()])
    return newest.selectExpr("entity_id", *flag_values())


def _sql_flag(j: int, column: str) -> str:
    hit = f"month = {j % 12 + 1} AND priority = {j % 5 + 1}"
    value = (f"CASE WHEN bool_or({hit} AND status_code = 'F') THEN '!' WHEN bool_or({hit}) THEN ' '"
             " ELSE year || '-12-31' END")  # fmt: skip
    if j == 27:
        value = f"CASE WHEN count(*) FILTER (WHERE status_code = 'P') = 0 THEN {value} END"
    return f"{value} AS {column}"


cte("x_raw_flags", f"""
SELECT entity_id, {", ".join(_sql_flag(j, c) for j, c in enumerate(P.REQUIREMENT_COLUMNS))},
       make_date(CAST(year AS INTEGER), 12, 31) AS surveyed, make_date(CAST(year AS INTEGER), 12, 31) AS collected
FROM x_owned GROUP BY entity_id, year
""")
cte("x_flags", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY collected DESC) AS rn FROM x_raw_flags) WHERE rn = 1
""")


# --- contracts ---------------------------------------------------------------------------

MODALITY = {1: "8.0", 2: "9", 3: "6.0", 4: "4.0", 5: "6"}


def raw_contracts(t: Tables) -> DataFrame:
    """Contract versions; the same contract number recurs within a month."""

    def build(t: Tables) -> DataFrame:
        key = F.col("entity_id").cast("string")
        year, month = F.col("year").cast("string"), F.col("month").cast("string")
        code = F.when((F.col("priority") == 4) & (F.col("status_code") == "P"), "").otherwise(key)
        unit = F.struct(
            code.alias("codigoIbge"),
            F.col("name").alias("municipioNome"),
            F.col("state").alias("ufSigla"),
            F.concat(F.lit("Unidade "), F.col("status_code")).alias("nomeUnidade"),
        )
        body = F.struct(F.lpad(key, 14, "0").alias("cnpj"), F.concat(F.lit("Orgao "), F.col("state")).alias("razaoSocial"))
        money = (F.col("price").cast("decimal(18,2)") * 20000).cast("decimal(18,2)").cast("string")
        return owned_orders(t).select(
            F.concat_ws("-", key, year, month).alias("contract_id"),
            "state",
            F.concat(year, F.lit(".0")).alias("purchase_year"),
            F.concat(month, F.lit(".0")).alias("month"),
            choose("priority", MODALITY).alias("modality"),
            F.to_json(unit).alias("unit_json"),
            F.to_json(body).alias("body_json"),
            F.col("price").cast("decimal(18,2)").cast("string").alias("estimated_value"),
            F.when(F.col("priority") != 5, money).alias("awarded_value"),
            F.concat(F.col("day").cast("string"), F.lit("T08:00:00")).alias("published"),
            F.concat(F.col("day").cast("string"), F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias(
                "updated"
            ),
            F.when((F.col("status_code") == "O") & (F.col("priority") == 3), "True")
            .when(F.col("status_code") == "F", "False")
            .alias("no_data"),
        )

    return t.shared("raw_contracts", build)


cte("x_raw_contracts", f"""
SELECT entity_id || '-' || year || '-' || month AS contract_id, state, year AS purchase_year, month,
       CAST(CAST({sql_case("priority", MODALITY)} AS DOUBLE) AS BIGINT) AS modality,
       CASE WHEN priority = 4 AND status_code = 'P' THEN NULL ELSE entity_id END AS entity_id, name AS entity_name,
       state AS unit_state, 'Unidade ' || status_code AS unit_name, lpad(CAST(entity_id AS VARCHAR), 14, '0') AS body_tax_id,
       'Orgao ' || state AS body_name, price AS estimated_value,
       CASE WHEN priority <> 5 THEN CAST(CAST(price AS DECIMAL(18,2)) * 20000 AS DOUBLE) END AS awarded_value,
       day AS published, day AS updated, o_orderkey AS version,
       CASE WHEN status_code = 'O' AND priority = 3 THEN 'True' WHEN status_code = 'F' THEN 'False' END AS no_data
FROM x_owned
""")
cte("x_contracts", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY updated DESC, version DESC) AS rn
  FROM x_raw_contracts WHERE no_data IS NULL OR no_data <> 'True') WHERE rn = 1
""")


def contracts(t: Tables) -> DataFrame:
    """The same contracts as already typed columns, newest version each."""

    def build(t: Tables) -> DataFrame:
        award = (F.col("price").cast("decimal(18,2)") * 20000).cast("double")
        rows = owned_orders(t).filter("NOT (status_code = 'O' AND priority = 3)").select(
            F.concat_ws("-", "entity_id", "year", "month").alias("contract_id"),
            F.when(F.expr("NOT (priority = 4 AND status_code = 'P')"), F.col("entity_id")).alias("entity_id"),
            F.col("year").cast("bigint").alias("purchase_year"),
            choose("priority", MODALITY).cast("double").cast("bigint").alias("modality"),
            F.when(F.col("priority") != 5, award).alias("awarded_value"),
            F.col("day").alias("published"),
            F.col("o_orderkey").alias("version"),
        )
        return keep_first(rows, ["contract_id"], [F.col("published").desc(), F.col("version").desc()])

    return t.shared("contracts", build)


# --- all-text inputs ---------------------------------------------------------------------


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def raw_dim(t: Tables) -> DataFrame:
    """Every entity twice, as after a repeated load."""
    return as_text(dim(t).unionByName(dim(t)))


def raw_lines(lines: DataFrame) -> DataFrame:
    """Lines as text, each also with a smaller value, as older versions of a report have."""
    return as_text(lines.withColumn("value", F.explode(F.array(F.col("value"), F.col("value") - 1.0))))


# --- snapshots ---------------------------------------------------------------------------

SEVERE_TYPES = ["error", "purchase", "view"]


def snapshots(t: Tables) -> DataFrame:
    def build(t: Tables) -> DataFrame:
        score = F.when(F.col("event_type") != "signup", F.least(half_away(F.col("value") / 5.0, 1), F.lit(100.0)))
        rank = F.when(score >= 75, 0).when(score >= 55, 1).when(score >= 35, 2).when(score.isNotNull(), 3).otherwise(4)
        severe = F.col("event_type").isin(SEVERE_TYPES)
        ts = F.col("ts").cast("timestamp")
        return t.raw("events").select(
            F.concat(F.lit("R"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"),
            ts.alias("snapshot_ts"),
            ts.cast("date").alias("snapshot_date"),
            state_at(F.col("user_id") % 25).alias("state"),
            F.col("user_id").cast("string").alias("entity_id"),
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
            score.alias("score"),
            class_label(rank).alias("risk_class"),
            F.when(severe, F.length("event_type")).otherwise(0).cast("bigint").alias("n_severe"),
            F.when(severe, 1.0).otherwise(0.0).alias("compliance_risk"),
            F.col("value").alias("score_raw"),
            F.get_json_object("props", "$.k").cast("bigint").alias("chronic_years"),
        )

    return t.shared("snapshots", build)


CLASS_LIST = f"[{sql_list([*P.RISK_CLASSES, P.NO_DATA_CLASS])}]"
cte("x_snapshots", f"""
SELECT *, list_extract({CLASS_LIST}, CASE WHEN score >= 75 THEN 1 WHEN score >= 55 THEN 2 WHEN score >= 35 THEN 3
                                          WHEN score IS NOT NULL THEN 4 ELSE 5 END) AS risk_class
FROM (
  SELECT 'R' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, ts AS snapshot_ts, CAST(ts AS DATE) AS snapshot_date,
         list_extract({SQL_STATES}, user_id % 25 + 1) AS state, CAST(user_id AS VARCHAR) AS entity_id,
         'User ' || user_id AS name,
         CASE WHEN event_type <> 'signup' THEN least({sql_half_away("(value / 5e0)", 1)}, 100e0) END AS score,
         CASE WHEN event_type IN ({sql_list(SEVERE_TYPES)}) THEN length(event_type) ELSE 0 END AS n_severe,
         CASE WHEN event_type IN ({sql_list(SEVERE_TYPES)}) THEN 1e0 ELSE 0e0 END AS compliance_risk,
         value AS score_raw, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chronic_years
  FROM events)
""")

"""Raw all-text tables -> typed, de-duplicated staging frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions.dates import parse_date_multi
from riskspark.functions.numbers import cast_via_float, parse_bool, parse_decimal_comma, percent_to_unit
from riskspark.functions.ratings import grade_factor, grade_from_text, status_rank
from riskspark.functions.text import normalize_code, strip_suffix, upper_trim, zero_pad
from riskspark.operators import accounts as ACC
from riskspark.operators.dedupe import dedupe_latest, keep_first
from riskspark.session import written

LINE_TYPES = {
    "entity_id": "bigint",
    "state": "string",
    "institution": "string",
    "year": "bigint",
    "period": "int",
    "regime": "string",
    "annex": "string",
    "sphere": "string",
    "column_label": "string",
    "account_code": "string",
    "account_name": "string",
    "value": "double",
    "population": "bigint",
}
BUDGET_KEY = ["entity_id", "year", "period", "annex", "account_code", "column_label", "account_name", "sphere"]
FISCAL_KEY = [*BUDGET_KEY[:3], "regime", *BUDGET_KEY[3:]]
PERIOD_KEY = BUDGET_KEY[:3]
CONTRACT_MARKER = "True"


def cast_columns(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strict typed projection: a value that does not fit its type fails the job."""
    return raw.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def typed_lines(raw: DataFrame) -> DataFrame:
    return cast_columns(raw, LINE_TYPES)


def _repeated_line_order(df: DataFrame, key: list[str]) -> list[Column]:
    rest = [c for c in df.columns if c not in {*key, "value"}]
    return [F.col("value").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]]


def stage_budget_lines(raw: DataFrame) -> DataFrame:
    """One row per budget-line key; of repeated lines the largest value stays."""
    lines = typed_lines(raw)
    return keep_first(lines, BUDGET_KEY, _repeated_line_order(lines, BUDGET_KEY))


def stage_fiscal_lines(raw: DataFrame) -> DataFrame:
    lines = typed_lines(raw)
    return keep_first(lines, FISCAL_KEY, _repeated_line_order(lines, FISCAL_KEY))


def read_whole() -> Column:
    """An aggregate that reads the column which nothing else needs: text that does not fit fails the job, as in staged lines."""
    return F.count("population").alias("_read")


def staged_budget_periods(lines: DataFrame) -> DataFrame:
    """``accounts.budget_periods`` of the staged lines, from typed lines with repeats, written once.

    Measures are maxima over the key's columns, which repeats do not change, so lines are reduced before any shuffle.
    Which line of a key stays matters only to the states that report: where the lines of a period name several
    states, these come from its staged lines.
    """
    parts = [ACC.reporting_states().alias("_states"), ACC.line_states().alias("_named"), read_whole()]
    pivoted = ACC.pivot_lines(lines, PERIOD_KEY, P.BUDGET_RULES, *parts)
    periods = written(pivoted, "budget-periods").drop("_read")
    mixed = periods.filter(F.bit_count("_named") > 1)
    if mixed.isEmpty():
        return periods.drop("_named")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in PERIOD_KEY]
    of_mixed = lines.alias("l").join(mixed.alias("m").select(*[f"m.{c}" for c in PERIOD_KEY]), same, "left_semi")
    staged = keep_first(of_mixed, BUDGET_KEY, _repeated_line_order(lines, BUDGET_KEY))
    known = written(ACC.budget_periods(staged), "mixed-periods").select(*periods.drop("_named").columns)
    return periods.filter("coalesce(bit_count(_named), 0) <= 1").drop("_named").unionByName(known)


def staged_fiscal_records(lines: DataFrame) -> DataFrame:
    """``accounts.fiscal_records`` of the staged lines, from typed lines with repeats: all it reads is in the key, or a maximum."""
    return ACC.fiscal_records(lines, read_whole()).filter("_read >= 0").drop("_read")


def stage_dim(raw: DataFrame) -> DataFrame:
    rows = cast_columns(raw, {"entity_id": "bigint", "state": "string", "name": "string", "population": "bigint"})
    return dedupe_latest(rows, ["entity_id"], [])


def stage_accounts(raw: DataFrame) -> DataFrame:
    """Annual accounts per (entity, year); the availability flags arrive as boolean text."""
    numbers = ["tax_revenue", "current_revenue", "financial_assets", "financial_liabilities"]
    rows = raw.select(
        F.col("entity_id").cast("bigint").alias("entity_id"),
        "state",
        F.col("year").cast("bigint").alias("year"),
        *[F.col(c).cast("double").alias(c) for c in numbers],
        parse_bool(F.col("balance_available")).alias("balance_available"),
        parse_bool(F.col("revenue_available")).alias("revenue_available"),
        F.col("population").cast("bigint").alias("population"),
    )
    return dedupe_latest(rows, ["entity_id", "year"], [])


def stage_ratings(raw: DataFrame) -> DataFrame:
    """One rating per (entity, year): final, then preliminary, then anything else."""
    rows = raw.select(
        upper_trim(F.col("state")).alias("state"),
        zero_pad(F.col("entity_code")).cast("bigint").alias("entity_id"),
        F.col("year").cast("bigint").alias("year"),
        F.col("edition").cast("bigint").alias("edition"),
        F.col("status").alias("status"),
        upper_trim(F.col("grade")).alias("grade"),
        F.col("factor").cast("double").alias("factor"),
        F.col("percent").cast("double").alias("percent"),
        F.col("position").try_cast("bigint").alias("position"),
    )
    return newest_ratings(rows.dropna(subset=["state", "entity_id", "year"]))


def newest_ratings(typed_ratings: DataFrame) -> DataFrame:
    rest = ["percent", "grade", "factor", "edition", "position", "status", "state"]
    order = [status_rank(F.col("status")), *[F.col(c).desc_nulls_last() for c in rest]]
    return keep_first(typed_ratings, ["entity_id", "year"], order)


# fixed values: published column titles of the compliance bulk file
COMPLIANCE_TITLES = {
    "UF": "state",
    "Nome do Ente Federado": "name",
    "Código IBGE": "entity_id",
    "Código SIAFI": "siafi_code",
    "Região": "region",
    "População": "population",
    "Fonte": "source",
}


def rename_compliance(raw: DataFrame) -> DataFrame:
    """Column titles and requirement codes of the bulk file -> semantic names."""
    codes = {code: column for column, code, _, _ in P.REQUIREMENTS}
    return raw.withColumnsRenamed({**COMPLIANCE_TITLES, **codes})


def stage_flags(raw: DataFrame) -> DataFrame:
    """Newest compliance row per entity, by parsed collection then survey date."""
    rows = raw.withColumns(
        {
            "entity_id": F.col("entity_id").cast("bigint"),
            "_collected_text": F.col("collected"),
            "collected": parse_date_multi(F.col("collected")),
            "surveyed": parse_date_multi(F.col("surveyed")),
        }
    )
    newest = dedupe_latest(rows, ["entity_id"], ["collected", "surveyed", "_collected_text"])
    return newest.drop("_collected_text")


UNIT_SCHEMA = "codigoIbge string, municipioNome string, ufSigla string, nomeUnidade string"
BODY_SCHEMA = "cnpj string, razaoSocial string"
CONTRACT_UNIT = ["entity_id", "entity_name", "unit_state", "unit_name", "body_tax_id", "body_name"]


def flatten_json(raw: DataFrame) -> DataFrame:
    """Nested unit and body objects -> columns; each object is parsed once."""
    parsed = raw.withColumns(
        {"_unit": F.from_json("unit_json", UNIT_SCHEMA), "_body": F.from_json("body_json", BODY_SCHEMA)}
    )
    return parsed.withColumns(
        {
            "entity_id": cast_via_float(F.col("_unit.codigoIbge")),
            "entity_name": F.col("_unit.municipioNome"),
            "unit_state": F.col("_unit.ufSigla"),
            "unit_name": F.col("_unit.nomeUnidade"),
            "body_tax_id": F.col("_body.cnpj"),
            "body_name": F.col("_body.razaoSocial"),
        }
    ).drop("_unit", "_body", "unit_json", "body_json")


def exclude_marker(raw: DataFrame) -> DataFrame:
    """Rows that only mark an empty block leave."""
    return raw.filter(F.col("no_data").isNull() | (F.col("no_data") != CONTRACT_MARKER))


def stage_contracts(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest version of each contract. Dates are strict: a bad one fails the job.

    ``columns``: those that the caller reads, all by default. Equal versions are told apart column by column, so what
    stands behind the last of ``columns`` changes none of them and stays out of the shuffle.
    """
    rows = flatten_json(exclude_marker(raw))
    staged = {
        "contract_id": F.col("contract_id"),
        "state": F.col("state"),
        "purchase_year": cast_via_float(F.col("purchase_year")),
        "month": cast_via_float(F.col("month")),
        "modality": cast_via_float(F.col("modality")),
        **{name: F.col(name) for name in CONTRACT_UNIT},
        "estimated_value": F.col("estimated_value").cast("double"),
        "awarded_value": F.col("awarded_value").cast("double"),
        "published": F.to_date(F.substring("published", 1, 10), "yyyy-MM-dd"),
        "updated": F.to_date(F.substring("updated", 1, 10), "yyyy-MM-dd"),
    }
    if columns is not None:
        staged = {name: staged[name] for name in columns}
        last = max(rows.columns.index(name) for name in columns)
        rows = rows.select(*[c for k, c in enumerate(rows.columns) if k <= last or c in ("contract_id", "updated")])
    newest = dedupe_latest(rows, ["contract_id"], ["updated"])
    return newest.select(*[value.alias(name) for name, value in staged.items()])


def derive_block_fields(raw: DataFrame, default_state: str, audit: dict[str, str]) -> DataFrame:
    """State and month from block tags, else from the publication date, plus audit columns.

    Optional inputs: block_state, block_month ('yyyy-MM'), updated, updated_alias.
    """

    def optional(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    tagged = F.month(F.try_to_date(F.concat(optional("block_month"), F.lit("-01")), "yyyy-MM-dd"))
    published = F.month(F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd"))
    return raw.withColumns(
        {
            "state": F.coalesce(optional("block_state"), F.lit(default_state.upper())),
            "month": (tagged if "block_month" in raw.columns else published).cast("bigint"),
            "updated": F.coalesce(optional("updated"), optional("updated_alias")),
            **{name: F.lit(value) for name, value in audit.items()},
        }
    ).drop("block_state", "block_month", "updated_alias")


def stage_ranking_file(raw: DataFrame) -> DataFrame:
    """Final ranking file (all text, decimal comma) -> typed ratings."""
    code = normalize_code(F.col("ID_ENTE"))
    percent = percent_to_unit(parse_decimal_comma(F.col("PER_ACERTOS")))
    year = F.trim("VA_EXERCICIO").try_cast("bigint")
    rows = raw.select(
        F.when(code == P.FEDERAL_DISTRICT_CODE, "DF").otherwise(upper_trim(F.coalesce("UF", F.lit("")))).alias("state"),
        code.alias("entity_code"),
        strip_suffix(F.col("NOME_ENTE")).alias("name"),
        year.alias("year"),
        (year + 1).alias("edition"),
        F.lit(P.STATUS_FINAL).alias("status"),
        percent.alias("percent"),
        grade_from_text(F.col("NO_ICF"), percent).alias("grade"),
        F.trim("POS_RANKING").try_cast("bigint").alias("position"),
        parse_decimal_comma(F.col("TOTAL")).alias("total_points"),
        *[parse_decimal_comma(F.col(f"DIM-{n}")).alias(f"dim_{n.lower()}") for n in ("I", "II", "III", "IV")],
    )
    return rows.withColumn("factor", grade_factor(F.col("grade"))).dropna(subset=["state", "entity_code", "year"])


RANKING_COLUMNS = [
    "ID_ENTE", "NOME_ENTE", "UF", "VA_EXERCICIO", "TOTAL", "DIM-I", "DIM-II", "DIM-III", "DIM-IV",
    "PER_ACERTOS", "NO_ICF", "POS_RANKING",
]


def union_ratings(final: DataFrame, preliminary: DataFrame) -> DataFrame:
    """Final and preliminary ratings in one table; per (state, entity, year) the final one stays."""
    both = final.unionByName(preliminary, allowMissingColumns=True)
    rank = F.when(F.col("status") == P.STATUS_FINAL, 0).when(F.col("status") == P.STATUS_PRELIMINARY, 1).otherwise(9)
    rest = [F.col(c).desc_nulls_last() for c in ("percent", "grade", "edition")]
    return keep_first(both, ["state", "entity_code", "year"], [rank, *rest])

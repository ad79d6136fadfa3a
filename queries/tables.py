"""Source, sink, stream and data-quality queries.

File queries first write whole tables to the shared work folder in the format under test, then
read them back with the engine's reader.
"""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queries import indicators as I
from queries import scores as SC
from queries import shapes as S
from queries.core import Tables, cte, query, sql_case, sql_half_away, sql_list
from riskspark import params as P
from riskspark.functions.numbers import half_away
from riskspark.operators import quality as Q
from riskspark.plans import history as H
from riskspark.plans import score, staging
from riskspark.plans.grades import sheet_counts as sheets_per_year
from riskspark.sinks import serving
from riskspark.sinks import tables as K
from riskspark.sources import files as R
from riskspark.streaming import incremental as X


def write_lines(lines: DataFrame, path: str, preamble: list[str]) -> None:
    """Text files that each start with the same preamble lines."""

    def headed(batches):
        yield pd.DataFrame({"value": preamble})
        for batch in batches:
            yield batch[["value"]]

    lines.select("value").mapInPandas(headed, "value string").write.text(path)


# --- sources -----------------------------------------------------------------------------


@query(
    "scan_state_filter",
    "entity_id:l state:s name:s population:l",
    "SELECT * FROM x_dim WHERE state IN ('BA', 'PB', 'SC')",
)
def scan_state_filter(t: Tables) -> DataFrame:
    path = t.path("dim")
    K.materialize(S.dim(t), path, ["state"], ["entity_id"])
    return R.read_raw(t.spark, path, ["ba", "pb", "sc"])


@query(
    "src_preamble_csv",
    "entity_id:l state:s name:s population:l survey_date:s req_previdenciaria_rpps:s",
    """SELECT entity_id, state, name, population, '21/11/2001' AS survey_date,
              CASE WHEN population > 100000 THEN '!' ELSE '30/11/2001' END AS req_previdenciaria_rpps FROM x_dim""",
)
def src_preamble_csv(t: Tables) -> DataFrame:
    path = t.path("bulk")
    flag = F.when(F.col("population") > 100000, "!").otherwise("30/11/2001")
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    text = F.concat_ws(";", "state", name, F.lpad(F.col("entity_id").cast("string"), 7, "0"), "population", flag)
    preamble = [
        '"Data da Pesquisa: 21/11/2001"', '"Fonte: Tesouro"', '""',
        'UF;"Nome do Ente Federado";"Código IBGE";"População";"1.1"',
    ]
    write_lines(S.dim(t).select(text.alias("value")), path, preamble)
    return staging.rename_compliance(R.read_preamble_csv(t.spark, path))


@query(
    "src_jsonl_clean",
    "contract_id:l price:d state:s",
    "SELECT o_orderkey AS contract_id, price, state FROM x_owned WHERE priority < 4",
)
def src_jsonl_clean(t: Tables) -> DataFrame:
    path = t.path("jsonl")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("contract_id"), "price", "state"))
    marker = F.to_json(F.struct(F.lit(True).alias("_sem_dados"), F.col("state")))
    line = F.when(F.col("priority") == 4, F.substring(record, 1, 25)).when(F.col("priority") == 5, marker)
    S.owned_orders(t).select(line.alias("bad"), record.alias("good")).select(
        F.coalesce("bad", "good").alias("value")
    ).write.text(path)
    schema = T.StructType().add("contract_id", T.LongType()).add("price", T.DoubleType()).add("state", T.StringType())
    return R.read_jsonl_checked(t.spark, path, schema)


# two decimals of a percentage, divided by 100 as the reader does
RANKING_PERCENT = (f"(CAST(CAST({sql_half_away('(0.55e0 + price / 500000e0 * 0.45e0)', 4)} * 100 AS DECIMAL(18,2)) AS DOUBLE)"
                   " / 100e0)")  # fmt: skip


@query(
    "src_decimal_comma",
    "entity_code:s name:s state:s year:l edition:l percent:d grade:s factor:d total_points:d dim_ii:d position:l",
    f"""SELECT lpad(CAST(entity_id AS VARCHAR), 7, '0') AS entity_code, 'Cidade São ' || entity_id AS name, state, year,
              year + 1 AS edition, percent, grade, {S.SQL_FACTOR.format(g="grade")} AS factor, price AS total_points,
              NULL AS dim_ii, o_orderkey AS position
       FROM (SELECT *, {S.SQL_GRADE.format(p="percent")} AS grade
             FROM (SELECT *, {RANKING_PERCENT} AS percent FROM x_owned WHERE entity_id <> 53))
       UNION ALL
       SELECT '{P.FEDERAL_DISTRICT_CODE}', 'Cidade São 53', 'DF', year, year + 1, percent, grade,
              {S.SQL_FACTOR.format(g="grade")}, price, NULL, o_orderkey
       FROM (SELECT *, {S.SQL_GRADE.format(p="percent")} AS grade
             FROM (SELECT *, {RANKING_PERCENT} AS percent FROM x_owned WHERE entity_id = 53))""",
)
def src_decimal_comma(t: Tables) -> DataFrame:
    """Files in Latin-1, as older publications are."""
    path = t.path("ranking")
    percent = half_away(F.lit(0.55) + F.col("price") / 500000.0 * 0.45, 4)
    comma = F.translate(F.format_number("price", 2), ",.", ".,")
    line = F.concat_ws(
        ";",
        F.col("entity_id").cast("string"),
        F.concat(F.lit("Cidade São "), F.col("entity_id").cast("string"), F.lit(" - "), F.col("state")),
        F.concat(F.lit(" "), F.lower("state")),
        F.col("year").cast("string"),
        comma, comma, F.lit("-"), F.lit(""), F.lit("NA"),
        F.replace(F.format_number(percent * 100.0, 2), F.lit("."), F.lit(",")),
        F.lit("?"),
        F.col("o_orderkey").cast("string"),
    )
    rows = S.owned_orders(t).select(line.alias("value"))
    header = t.spark.range(1).select(F.lit(";".join(staging.RANKING_COLUMNS)).alias("value"))
    rows.unionByName(header).write.option("encoding", "ISO-8859-1").option("header", False).option("quote", "").option(
        "escapeQuotes", False
    ).option("sep", "\u0001").csv(path)
    return staging.stage_ranking_file(R.read_separated(t.spark, path, staging.RANKING_COLUMNS))


@query("src_csv_typed", "code:s name:s population:l", """SELECT lpad(CAST(entity_id AS VARCHAR), 7, '0') AS code, name,
       population FROM x_dim""")  # fmt: skip
def src_csv_typed(t: Tables) -> DataFrame:
    path = t.path("csv")
    rows = S.dim(t).select(F.lpad(F.col("entity_id").cast("string"), 7, "0").alias("code"), "name", "population")
    rows.write.option("header", True).csv(path)
    return R.read_csv_typed(t.spark, path, "code string, name string, population bigint")


@query(
    "src_csv_inferred",
    "entity_id:l year:l n_lines:l value_max:d",
    "SELECT entity_id, year, count(*) AS n_lines, max(value) AS value_max FROM x_budget_lines GROUP BY entity_id, year",
)
def src_csv_inferred(t: Tables) -> DataFrame:
    path = t.path("csv-lines")
    S.budget_lines(t).select("entity_id", "year", "value", "annex").write.option("header", True).csv(path)
    rows = R.read_csv_inferred(t.spark, path)
    return rows.groupBy("entity_id", "year").agg(F.count(F.lit(1)).alias("n_lines"), F.max("value").alias("value_max"))


CONTRACT = ["entity_id", "year", "delivered", "budget_exec", "arrears_pct", "fiscal_period"]


@query(
    "src_union_states",
    "entity_id:l state:s year:l arrears_pct:d",
    "SELECT entity_id, state, year, arrears_pct FROM x_indicators WHERE state NOT IN ('AC', 'PB')",
)
def src_union_states(t: Tables) -> DataFrame:
    """Two state folders lack a required column and are skipped."""
    union, _skipped = R.union_state_files(t.spark, state_files(t), CONTRACT)
    return union


def state_files(t: Tables) -> str:
    base = t.path("states")
    rows = I.indicators(t).select("state", *CONTRACT)
    broken = F.col("state").isin("AC", "PB")
    rows.filter(~broken).write.partitionBy("state").parquet(base)
    rows.filter(broken).drop("budget_exec").write.mode("append").partitionBy("state").parquet(base)
    return base


@query(
    "src_skipped_files",
    "state:s missing:s",
    "SELECT DISTINCT state, 'budget_exec' AS missing FROM x_indicators WHERE state IN ('AC', 'PB')",
)
def src_skipped_files(t: Tables) -> DataFrame:
    """What the column contract reports: each state with a skipped file, and the columns that it lacks."""
    _union, skipped = R.union_state_files(t.spark, state_files(t), CONTRACT)
    rows = sorted({(f.state, ", ".join(f.missing)) for f in skipped})
    return t.spark.createDataFrame(rows, "state string, missing string")


SHEET_GRADES = {"1": "A+", "2": "a", "3": " B ", "4": "n.d.", "5": "C"}
SHEET_GRADE_VALUES = {1: "A+", 2: "A", 3: "B", 4: "N.D.", 5: "C"}


@query(
    "discover_columns",
    "file:s sheet:s entity_code:s name:s state:s grade:s note1:s",
    f"""SELECT 'capag-' || year AS file, 'CAPAG oficial' AS sheet,
              lpad(CAST(entity_id AS VARCHAR), 7, '0') AS entity_code, name, state,
              {sql_case("priority", SHEET_GRADE_VALUES)} AS grade, status_code AS note1 FROM x_owned""",
)
def discover_columns(t: Tables) -> DataFrame:
    return graded_rows(t)


@query(
    "sheet_counts",
    "year:l sheet:s n_rows:l",
    "SELECT year, 'CAPAG oficial' AS sheet, count(*) AS n_rows FROM x_owned GROUP BY year",
)
def sheet_counts(t: Tables) -> DataFrame:
    return sheets_per_year(graded_rows(t))


def graded_rows(t: Tables) -> DataFrame:
    """One workbook per year: cover rows, a decoy sheet, then the graded sheet."""
    orders = S.owned_orders(t)
    body = orders.select(
        F.concat(F.lit("capag-"), F.col("year").cast("string")).alias("file"),
        F.lit("CAPAG oficial").alias("sheet"),
        (F.col("o_orderkey") + 3).alias("row_index"),
        F.col("year"),
        F.array(
            F.lit("x"),
            F.col("state"),
            F.concat(F.col("entity_id").cast("string"), F.lit(" ")),
            F.col("name"),
            S.choose("cast(priority as string)", SHEET_GRADES),
            F.col("status_code"),
        ).alias("cells"),
    )
    files = orders.select("year").distinct()
    heads = files.selectExpr(
        "concat('capag-', year) AS file",
        "year",
        "inline(array("
        "named_struct('sheet', 'CAPAG oficial', 'row_index', 0L, 'cells', array('Relatório', '', '', '', '', '')),"
        "named_struct('sheet', 'CAPAG oficial', 'row_index', 2L, 'cells', array('Seq', 'UF', 'Cód. IBGE cod_ibge',"
        " 'Município', concat('CAPAG ', year + 1), 'Nota 1')),"
        "named_struct('sheet', 'CAPAG oficial', 'row_index', 1L, 'cells', array('Seq', 'UF', 'Cod.IBGE',"
        " 'Município', concat('CAPAG ', year + 1), 'Nota 1')),"
        "named_struct('sheet', 'Anexo', 'row_index', 0L, 'cells', array('UF', 'Cod.IBGE', 'CAPAG', '', '', ''))))",
    ).select("file", "sheet", "row_index", "year", "cells")
    return R.discover_columns(body.unionByName(heads))


@query("first_source", "entity_id:l state:s", "SELECT entity_id, state FROM x_dim")
def first_source(t: Tables) -> DataFrame:
    path = t.path("fallback") + ".csv"
    S.dim(t).select("entity_id", "state").write.option("header", True).csv(path)
    return R.first_source(t.spark, ["no_such_table", path], "entity_id bigint, state string", strict=True)


# --- sinks -------------------------------------------------------------------------------


def ledger(t: Tables) -> DataFrame:
    return S.owned_orders(t).select(
        F.col("o_orderkey").alias("id"), "state", "year", "price", "status_code", F.lit(0).cast("bigint").alias("seq")
    )


def changes(t: Tables) -> DataFrame:
    """Two versions of every open order (the later one counts) and a new row per pending one."""
    rows = ledger(t)
    opened, pending = rows.filter("status_code = 'O'"), rows.filter("status_code = 'P'")
    return (
        opened.withColumns({"price": F.col("price") + 1.0, "seq": F.lit(1).cast("bigint")})
        .unionByName(opened.withColumns({"price": F.col("price") + 2.0, "seq": F.lit(2).cast("bigint")}))
        .unionByName(pending.withColumns({"id": -F.col("id") - 1, "seq": F.lit(3).cast("bigint")}))
    )


cte("x_ledger", "SELECT o_orderkey AS id, state, year, price, status_code FROM x_owned")
cte("x_merged", """
SELECT id, state, year, price, status_code FROM x_ledger WHERE status_code <> 'O'
UNION ALL SELECT id, state, year, price + 2e0, status_code FROM x_ledger WHERE status_code = 'O'
UNION ALL SELECT -id - 1, state, year, price, status_code FROM x_ledger WHERE status_code = 'P'
""")
LEDGER_SPEC = "id:l state:s year:l price:d status_code:s"


@query(
    "sink_append",
    LEDGER_SPEC,
    "SELECT * FROM x_ledger UNION ALL SELECT * FROM x_ledger WHERE status_code = 'F'",
)
def sink_append(t: Tables) -> DataFrame:
    path = t.path("append")
    K.append_rows(ledger(t).limit(0), path)
    K.append_rows(ledger(t), path, truncate=True)
    K.append_rows(ledger(t).filter("status_code = 'F'"), path)
    return t.spark.read.parquet(path)


@query("upsert_merge", LEDGER_SPEC, source="x_merged")
def upsert_merge(t: Tables) -> DataFrame:
    path = t.path("upsert")
    K.upsert(ledger(t), path, ["id"], "seq", buckets=8)
    K.upsert(changes(t), path, ["id"], "seq", buckets=8)
    return K.read_upserted(t.spark, path)


@query(
    "upsert_typed",
    f"{LEDGER_SPEC} note:s stamped:b",
    "SELECT *, NULL AS note, TRUE AS stamped FROM x_merged",
)
def upsert_typed(t: Tables) -> DataFrame:
    path = t.path("upsert-typed")
    schema = {"id": "bigint", "state": "string", "year": "int", "price": "double", "status_code": "string", "note": "string"}
    for batch in (ledger(t), changes(t)):
        texts = batch.withColumns({"year": F.col("year").cast("string"), "price": F.col("price").cast("string")})
        K.typed_upsert(texts, path, schema, ["id"], "seq", buckets=8)
    return K.read_upserted(t.spark, path).withColumn("stamped", F.col("updated_at").isNotNull())


@query(
    "replace_slice",
    LEDGER_SPEC,
    """SELECT * FROM x_ledger l WHERE year <> 2000 OR state NOT IN (
         SELECT state FROM x_ledger WHERE year = 2000 AND status_code = 'F')
       UNION ALL SELECT id, state, year, price * 2e0, status_code FROM x_ledger WHERE year = 2000 AND status_code = 'F'""",
)
def replace_slice(t: Tables) -> DataFrame:
    path = t.path("slices")
    K.replace_slice(ledger(t), path, ["id"], ["year"], "seq")
    batch = ledger(t).filter("year = 2000 AND status_code = 'F'").withColumn("price", F.col("price") * 2.0)
    K.replace_slice(batch, path, ["id"], ["year"], "seq")
    return t.spark.read.parquet(path)


@query("append_slice", LEDGER_SPEC, source="x_ledger")
def append_slice(t: Tables) -> DataFrame:
    path = t.path("backfill")
    rows = ledger(t)
    K.append_slice(rows.filter("year < 1998"), path, ["id"], ["year"], "seq")
    late = rows.filter("year >= 1998")
    K.append_slice(late.unionByName(late), path, ["id"], ["year"], "seq")
    return t.spark.read.parquet(path)


SNAP_SPEC = "run_id:s snapshot_date:dt state:s entity_id:s score:d risk_class:s"


@query(
    "snapshot_replace_day",
    SNAP_SPEC,
    """SELECT * FROM x_snapshots WHERE snapshot_date <> DATE '2024-01-03'
       UNION ALL SELECT * REPLACE ('again' AS run_id) FROM x_snapshots
       WHERE snapshot_date = DATE '2024-01-03' AND score IS NOT NULL
       UNION ALL SELECT * FROM x_snapshots WHERE snapshot_date = DATE '2024-01-03' AND state NOT IN (
         SELECT state FROM x_snapshots WHERE snapshot_date = DATE '2024-01-03' AND score IS NOT NULL)""",
)
def snapshot_replace_day(t: Tables) -> DataFrame:
    path = t.path("history")
    rows = S.snapshots(t).select("run_id", "snapshot_date", "state", "entity_id", "score", "risk_class")
    H.replace_daily_snapshot(rows, path)
    again = rows.filter("snapshot_date = DATE '2024-01-03' AND score IS NOT NULL").withColumn("run_id", F.lit("again"))
    H.replace_daily_snapshot(again, path)
    return t.spark.read.parquet(path)


RUN = H.Run("run-1", date(2001, 11, 30), datetime(2001, 11, 30, 12), "v1", pipeline_mode="full", notes="first", fiscal_ref="2001-6")
PUBLISHED = (
    "name:s population:l score:d risk_class:s score_base:d years_delivered:l arrears_pct_latest:d mean_factor:d points_liquidity:d"
    " budget_preliminary:b liquidity_rating_missing:b arrears_missing:b arrears_stale:b autonomy_missing:b pending_json:s"
    " award_alert:b"
)


@query(
    "publish_snapshot",
    f"run_id:s snapshot_date:dt state:s entity_id:s {PUBLISHED} rows_written:l rows_scored:l score_median:d status:s"
    " pipeline_mode:s source_mode:s fiscal_ref:s notes:s",
    """SELECT s.* REPLACE (lpad(CAST(s.entity_id AS VARCHAR), 7, '0') AS entity_id), 'run-1' AS run_id,
              DATE '2001-11-30' AS snapshot_date, l.rows_written, l.rows_scored, l.score_median, 'SUCCESS' AS status,
              'full' AS pipeline_mode, NULL AS source_mode, '2001-6' AS fiscal_ref, 'first' AS notes
       FROM x_scored s JOIN (SELECT state, count(*) AS rows_written, count(score) AS rows_scored, median(score) AS score_median
                             FROM x_scored GROUP BY state) l ON l.state = s.state""",
)
def publish_snapshot(t: Tables) -> DataFrame:
    """The score job's rows, beside the run log's."""
    path, log = t.path("published"), t.path("run-log")
    scored = score.score_job(SC.inputs(t), S.WINDOW, ranked=False)
    H.publish_snapshot(scored, path, log, RUN)
    runs = t.spark.read.parquet(log).drop("snapshot_date", "run_id", "methodology", "snapshot_ts")
    return t.spark.read.parquet(path).join(runs, "state")


@query(
    "materialize_partitioned",
    "entity_id:l state:s year:l period:l annex:s account_code:s value:d",
    "SELECT * FROM x_budget_lines WHERE year = 1999",
)
def materialize_partitioned(t: Tables) -> DataFrame:
    path = t.path("lines")
    K.materialize(S.budget_lines(t), path, ["year"], ["state", "entity_id"])
    return t.spark.read.parquet(path).filter("year = 1999")


@query(
    "schema_evolve",
    f"{LEDGER_SPEC} channel:s",
    """SELECT * REPLACE (CASE WHEN status_code <> 'P' THEN price END AS price),
              CASE WHEN status_code = 'P' THEN 'web' END AS channel FROM x_ledger WHERE status_code <> 'O'
       UNION ALL SELECT *, NULL FROM x_ledger WHERE status_code = 'O'""",
)
def schema_evolve(t: Tables) -> DataFrame:
    """A stored table through three upserts: a new column comes, another is absent, then the first is."""
    path = t.path("evolving")
    K.upsert(ledger(t), path, ["id"], "seq", buckets=8)
    pending = ledger(t).filter("status_code = 'P'").drop("price").withColumn("channel", F.lit("web"))
    K.upsert(pending, path, ["id"], "seq")
    K.upsert(ledger(t).filter("status_code = 'O'").withColumn("id", F.col("id").cast("decimal(20,0)")), path, ["id"], "seq")
    return K.read_upserted(t.spark, path)


@query(
    "export_csv",
    "line:l has_mark:b text:s",
    """SELECT 0 AS line, TRUE AS has_mark, 'entity_id,state,name,population' AS text
       UNION ALL SELECT row_number() OVER (ORDER BY state, entity_id), FALSE,
              entity_id || ',' || state || ',' || name || ',' || population FROM x_dim""",
)
def export_csv(t: Tables) -> DataFrame:
    """The lines of a sorted export into several files, numbered through all of them in order.

    Each file starts with the byte-order mark and the header; only the first header is shown.
    """
    path = t.path("export")
    K.export_csv(S.dim(t), path, [F.col("state"), F.col("entity_id")])
    lines = R.number_lines(t.spark, path).join(K.marked_files(t.spark, path), "file")
    head = F.col("line_of_file") == 0
    again = head & (F.col("file_number") > 0) & F.col("has_mark")  # a header without its mark would show
    line = (F.col("line") - F.col("file_number")).alias("line")
    return lines.filter(~again).select(line, (head & F.col("has_mark")).alias("has_mark"), F.col("value").alias("text"))


@query(
    "serving_records",
    "entity_id:l state:s name:s years_delivered:l budget_exec:d flagged:b n_history:l first_year:l",
    f"""SELECT o_orderkey AS entity_id, state, CASE WHEN priority <> 5 THEN name END AS name, priority AS years_delivered,
              CASE WHEN status_code <> 'P' THEN price END AS budget_exec,
              CASE WHEN status_code <> 'O' THEN priority > 2 END AS flagged, CASE WHEN priority < 3 THEN 1 ELSE 0 END
              AS n_history, CASE WHEN priority < 3 THEN year END AS first_year FROM x_owned
        WHERE state IN ({sql_list(S.STATES)})""",
)
def serving_records(t: Tables) -> DataFrame:
    history = F.concat(F.lit('[{"year":'), F.col("year").cast("string"), F.lit(',"arrears_pct":1.5,"chronic":false}]'))
    rows = S.owned_orders(t).select(
        F.col("o_orderkey").alias("entity_id"),
        F.lower("state").alias("state"),
        F.when(F.col("priority") == 5, "NaN").otherwise(F.col("name")).alias("name"),
        F.col("priority").cast("double").alias("years_delivered"),
        F.when(F.col("status_code") == "P", F.lit(float("nan"))).otherwise(F.col("price")).alias("budget_exec"),
        F.when(F.col("status_code") != "O", F.col("priority") > 2).alias("flagged"),
        F.when(F.col("priority") < 3, history).when(F.col("priority") == 3, "nan").alias("history"),
    )
    records = K.serving_records(rows, ["years_delivered"], ["flagged"], ["name"], ["budget_exec"], "history")
    return records.withColumns(
        {"n_history": F.size("history").cast("bigint"), "first_year": F.get(F.col("history"), 0)["year"]}
    )


@query("serving_sync", "entity_id:l state:s name:s population:l", source="x_dim")
def serving_sync(t: Tables) -> DataFrame:
    """Entities sent twice to a keyed store in batches, at first with other values, and read back from it."""
    path = t.path("store")
    for rows in (S.dim(t).withColumn("population", F.lit(0).cast("bigint")), S.dim(t)):
        serving.send_records(rows, "riskspark.sinks.serving:LogStore", {"path": path})
    return serving.read_log(t.spark, path, "entity_id bigint, state string, name string, population bigint")


# --- incremental loads -------------------------------------------------------------------


@query("stream_upsert", "contract_id:s updated:s price:d", """SELECT contract_id, updated, price FROM (
         SELECT entity_id || '-' || year AS contract_id, strftime(day, '%Y-%m-%d') || '-' || o_orderkey AS updated, price,
                row_number() OVER (PARTITION BY entity_id, year ORDER BY day DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn
         FROM x_owned) WHERE rn = 1""")  # fmt: skip
def stream_upsert(t: Tables) -> DataFrame:
    """All contract versions arrive in JSON files, a third of the statuses after the others."""
    source, target = t.path("landing"), t.path("contracts")
    checkpoint = t.path("stream-checkpoint")
    rows = S.owned_orders(t).select(
        F.concat_ws("-", "entity_id", "year").alias("contract_id"),
        F.concat_ws("-", "day", "o_orderkey").alias("updated"),
        "price",
        F.col("o_orderkey").alias("seq"),
        "status_code",
    )
    schema = "contract_id string, updated string, price double, seq bigint"
    for late in (False, True):
        arriving = rows.filter((F.col("status_code") == "F") == F.lit(late)).drop("status_code")
        arriving.write.mode("append").json(source)
        X.incremental_upsert(
            t.spark, source, schema, target, checkpoint, ["contract_id"], "seq", [F.col("updated").desc()],
            files_per_batch=3, buckets=8,
        )
    return K.read_upserted(t.spark, target)


@query(
    "stream_replace_slice",
    "id:l state:s year:l price:d",
    """SELECT id, state, year, price FROM x_ledger WHERE year < 2000
       UNION ALL SELECT id, state, year, price * 2e0 FROM x_ledger WHERE year >= 2000""",
)
def stream_replace_slice(t: Tables) -> DataFrame:
    """Each load lies in several files, taken one per batch; files of the first load arrive last.

    Markers say how many rows each load brings to a slice; those of the second come before its rows.
    """
    source, target = t.path("landing"), t.path("slices")
    checkpoint, markers = t.path("stream-checkpoint"), t.path("markers")
    schema = "id bigint, state string, year bigint, price double, seq bigint, load_id bigint"
    rows = ledger(t).drop("status_code")
    second = rows.filter("year >= 2000").withColumn("price", F.col("price") * 2.0)
    late = F.col("price") > 150_000.0
    arrivals = ((0, rows.filter(~late), second, 1), (1, second, None, None), (0, rows.filter(late), rows, 0))
    for number, load, announced, of in arrivals:
        load.withColumn("load_id", F.lit(number)).repartition(3).write.mode("append").json(source)
        if announced is not None:
            told = announced.groupBy("state", "year").agg(F.count("*").alias("expected_rows"))
            told.withColumn("load_id", F.lit(of)).write.mode("append").json(markers)
        X.incremental_replace_slice(
            t.spark, source, schema, target, checkpoint, ["id"], ["year"], "seq", "load_id", markers, files_per_batch=1
        )
    return t.spark.read.parquet(target)


# --- data quality ------------------------------------------------------------------------


def sql_checks(source: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER (WHERE {condition}) AS violations FROM {source}"
        for name, condition in checks.items()
    )


CHECK_SPEC = "check_name:s violations:l"
NULLABLE = ["entity_id", "year", "revenue_realized", "fiscal_regime"]


@query(
    "dq_not_null",
    CHECK_SPEC,
    sql_checks("x_base", {f"not_null_{c}": f"{c} IS NULL" for c in NULLABLE}),
)
def dq_not_null(t: Tables) -> DataFrame:
    return Q.not_null(I.base(t), NULLABLE)


@query(
    "dq_unique",
    "o_orderkey:l line:l n_rows:l",
    "SELECT o_orderkey, line, count(*) AS n_rows FROM x_order_lines GROUP BY o_orderkey, line HAVING count(*) > 1",
)
def dq_unique(t: Tables) -> DataFrame:
    return Q.unique(S.order_lines(t), ["o_orderkey", "line"])


@query(
    "dq_accepted",
    "value:s n_rows:l",
    "SELECT state AS value, count(*) AS n_rows FROM x_owned WHERE state NOT IN ('AC', 'AL', 'BA') GROUP BY state",
)
def dq_accepted(t: Tables) -> DataFrame:
    return Q.accepted_values(S.owned_orders(t), "state", ["AC", "AL", "BA"])


@query(
    "dq_keys",
    CHECK_SPEC,
    sql_checks("x_raw_contracts", {"blank_contract_id": "contract_id IS NULL", "blank_no_data": "no_data IS NULL",
                                   "foreign_state": "state <> 'PB'"}),
)
def dq_keys(t: Tables) -> DataFrame:
    return Q.key_checks(S.raw_contracts(t), ["contract_id", "no_data"], "pb")


@query(
    "dq_grid",
    CHECK_SPEC,
    sql_checks("x_budget_lines", {"unknown_state": "account_code IS NOT NULL AND value IS NOT NULL AND state = 'BA'",
                                  "year_out_of_range": "account_code IS NOT NULL AND value IS NOT NULL AND year = 1997"}),
)
def dq_grid(t: Tables) -> DataFrame:
    """Lines that the grid leaves out; here a state's name and a year are spoilt."""
    spoilt = {"state": F.when(F.col("state") == "BA", "??").otherwise(F.col("state")),
              "year": F.when(F.col("year") == 1997, 19970).otherwise(F.col("year"))}
    return Q.grid_checks(S.budget_lines(t).withColumns(spoilt))


@query(
    "dq_snapshot",
    CHECK_SPEC,
    sql_checks("x_snapshots", {"null_entity": "entity_id IS NULL", "unknown_class": "score < 10e0",
                               "score_out_of_range": "score_raw < 0 OR score_raw > 100", "bad_state": "length(state) <> 2"})
    + " UNION ALL SELECT 'duplicate_entity', count(*) FROM (SELECT entity_id FROM x_snapshots GROUP BY entity_id"
      " HAVING count(*) > 1) UNION ALL SELECT 'empty_snapshot', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM x_snapshots",
)
def dq_snapshot(t: Tables) -> DataFrame:
    """Some classes unknown, raw values as scores."""
    odd = F.when(F.col("score") < 10.0, "MUITO ALTO").otherwise(F.col("risk_class"))
    rows = S.snapshots(t).withColumn("risk_class", odd).withColumn("score", F.col("score_raw"))
    return Q.snapshot_checks(rows, [*P.RISK_CLASSES, P.NO_DATA_CLASS])


@query(
    "dq_dim_batch",
    CHECK_SPEC,
    """SELECT 'rows_of_state' AS check_name, count(*) FILTER (WHERE state = 'PB') AS violations FROM x_dim
       UNION ALL SELECT 'foreign_state', count(*) FILTER (WHERE state <> 'PB') FROM x_dim
       UNION ALL SELECT 'blank_code', count(*) FILTER (WHERE population < 3000) FROM x_dim""",
)
def dq_dim_batch(t: Tables) -> DataFrame:
    rows = S.dim(t).select(
        "state",
        F.lit("M").alias("level"),
        F.when(F.col("population") >= 3000, F.col("entity_id").cast("string")).otherwise(" ").alias("entity_code"),
    )
    states = rows.select(F.concat(F.lit(" "), F.lower("state")).alias("state"), F.lit("E").alias("level"), "entity_code")
    return Q.dimension_batch(rows.unionByName(states), "PB")

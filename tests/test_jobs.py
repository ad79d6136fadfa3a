from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from queries import shapes as S
from queries.core import Tables
from queries.scores import inputs, raw_inputs
from riskspark import params as P
from riskspark import session
from riskspark.operators.contracts import AGG_COLUMNS
from riskspark.plans import history as H
from riskspark.plans import score
from riskspark.plans import staging
from riskspark.sinks import tables as K
from riskspark.sources import files as R
from riskspark.streaming import incremental as X

FOLDER = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


HUB_DEFAULTS = {
    "state": ("string", "PB"), "population": ("bigint", 20000), "years_delivered": ("bigint", 6),
    "chronic_years": ("bigint", 0), "budget_exec": ("double", 100.0), "liquidity": ("double", 0.4),
    "decay": ("double", 1.0), "compliance_risk": ("double", 0.0), "autonomy_mean": ("double", 0.5),
    "budget_factor": ("double", 1.0), "liquidity_factor": ("double", 1.0), "arrears_factor": ("double", 1.0),
    "autonomy_factor": ("double", 1.0), "liquidity_partial": ("boolean", False),
}


def hub_row(spark, **changes):
    values = {name: (kind, changes.get(name, value)) for name, (kind, value) in HUB_DEFAULTS.items()}
    return spark.range(1).select(*[F.lit(value).cast(kind).alias(name) for name, (kind, value) in values.items()])


def scored(spark, **changes):
    components = score.score_components(hub_row(spark, **changes), S.WINDOW)
    return score.classify(score.final_score(components)).first()


def test_perfect_entity_scores_100(spark):
    row = scored(spark)
    assert (row.score, row.risk_class) == (100.0, P.RISK_CLASSES[0])


@pytest.mark.parametrize("missing", ["autonomy_mean", "liquidity", "arrears_factor"])
def test_score_survives_missing_indicators(spark, missing):
    row = scored(spark, **{missing: None})
    assert row.score is not None and row.score < 100


def test_no_budget_indicator_means_no_score(spark):
    row = scored(spark, budget_exec=None)
    assert (row.score, row.risk_class) == (None, P.NO_DATA_CLASS)


def test_missing_component_points_leave_no_score(spark):
    rows = score.final_score(
        score.score_components(hub_row(spark), S.WINDOW).withColumn("points_compliance", F.lit(None).cast("double"))
    )
    assert rows.first().score is None


def test_partial_liquidity_costs_five_points(spark):
    assert scored(spark, liquidity_partial=True).score == 95.0


def test_points_stay_within_weights(spark, tables):
    hub = score.indicator_hub(inputs(tables), S.WINDOW)
    rows = score.score_components(hub, S.WINDOW)
    broken = rows.filter(" OR ".join(f"NOT points_{n} BETWEEN 0 AND {w}" for n, w in P.WEIGHTS.items()))
    assert broken.count() == 0


def test_every_entity_is_scored_once(spark, tables):
    rows = score.score_job(inputs(tables), S.WINDOW, ranked=False).select("entity_id")
    assert rows.count() == rows.distinct().count() == S.dim(tables).count()


def test_one_state_alone_scores_like_all_states_together(spark, tables):
    full = inputs(tables)
    state = S.dim(tables).groupBy("state").count().orderBy(F.desc("count")).first().state
    ids = S.dim(tables).filter(F.col("state") == state).select("entity_id")

    def only(df):
        return df.join(ids, "entity_id", "left_semi")

    alone = score.Inputs(**{name: only(df) for name, df in vars(full).items()})
    fields = ["entity_id", "score", "risk_class"]
    together = score.score_job(full, S.WINDOW, ranked=False).filter(F.col("state") == state)
    assert as_rows(score.score_job(alone, S.WINDOW, ranked=False).select(*fields)) == as_rows(together.select(*fields))


def ledger(spark, rows):
    return spark.createDataFrame(rows, "id long, state string, year int, v string, seq long")


def test_upsert_is_idempotent_and_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, [(1, "PB", 2024, "a", 1), (2, "PB", 2024, "b", 1)]), path, ["id"], "seq", buckets=4)
    batch = ledger(spark, [(2, "PB", 2024, "old", 2), (2, "PB", 2024, "new", 3), (3, "PB", 2024, "c", 1)])
    for _ in range(2):
        K.upsert(batch, path, ["id"], "seq", buckets=4)
        got = as_rows(K.read_upserted(spark, path).select("id", "v"))
        assert got == [(1, "a"), (2, "new"), (3, "c")]


def test_upsert_adds_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, [(1, "PB", 2024, "a", 1)]), path, ["id"], "seq", buckets=2)
    K.upsert(ledger(spark, [(2, "PB", 2024, "b", 1)]).withColumn("extra", F.lit(7)), path, ["id"], "seq", buckets=2)
    assert as_rows(K.read_upserted(spark, path).select("id", "extra")) == [(1, None), (2, 7)]


def test_upsert_keeps_columns_that_a_later_batch_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, "PB", 2024, "a", 1) for i in range(200)]
    K.upsert(ledger(spark, rows), path, ["id"], "seq", buckets=4)
    K.upsert(ledger(spark, rows[:3]).withColumn("extra", F.lit(7)), path, ["id"], "seq")
    K.upsert(ledger(spark, rows[3:]), path, ["id"], "seq")
    got = K.read_upserted(spark, path)
    assert (got.count(), got.filter("extra = 7").count()) == (200, 3)


def test_upsert_holds_to_the_stored_buckets_keys_and_types(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = ledger(spark, [(i, "PB", 2024, "a", 1) for i in range(100)])
    K.upsert(rows, path, ["id"], "seq", buckets=8)
    K.upsert(rows, path, ["id"], "seq")
    K.upsert(rows.withColumn("id", F.col("id").cast("int")), path, ["id"], "seq")
    K.upsert(rows.withColumn("id", F.col("id").cast("string")), path, ["id"], "seq")
    assert K.read_upserted(spark, path).count() == 100
    with pytest.raises(ValueError, match="8 buckets"):
        K.upsert(rows, path, ["id"], "seq", buckets=64)
    with pytest.raises(ValueError, match="key is"):
        K.upsert(rows, path, ["id", "state"], "seq")
    with pytest.raises(Exception, match="does not fit"):
        K.upsert(rows.withColumn("id", F.lit("x1")), path, ["id"], "seq")
    assert K.read_upserted(spark, path).count() == 100
    assert [f for f in (tmp_path / "t").iterdir() if f.name.startswith("_replaced")] == []


def test_upsert_settles_ties_by_sequence_then_content(spark, tmp_path):
    batch = ledger(spark, [(1, "PB", 2024, v, s) for v, s in (("a", 1), ("c", 2), ("b", 2))])
    for n in (1, 5):
        path = str(tmp_path / f"t{n}")
        K.upsert(batch.repartition(n), path, ["id"], "seq", newest=[F.col("year").desc()], buckets=2)
        assert as_rows(K.read_upserted(spark, path).select("v")) == [("c",)]


def test_replace_slice_touches_only_its_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "PB", 2023, "a", 1), (2, "PB", 2024, "b", 1), (3, "CE", 2024, "c", 1)]
    K.replace_slice(ledger(spark, rows), path, ["id"], ["year"], "seq")
    batch = ledger(spark, [(9, "PB", 2024, "z", 1)])
    for _ in range(2):
        K.replace_slice(batch, path, ["id"], ["year"], "seq", state="PB")
    got = as_rows(spark.read.parquet(path).select("id", "state", "year"))
    assert got == [(1, "PB", 2023), (3, "CE", 2024), (9, "PB", 2024)]


@pytest.mark.parametrize(
    ("rows", "message"),
    [([(None, "PB", 2024, "a", 1)], "blank_id=1"), ([(1, "CE", 2024, "a", 1)], "foreign_state=1")],
)
def test_bad_batches_are_refused(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        K.replace_slice(ledger(spark, rows), str(tmp_path / "t"), ["id"], ["year"], "seq", state="PB")


def test_missing_key_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="batch lacks key columns: id"):
        K.upsert(ledger(spark, []).drop("id"), str(tmp_path / "t"), ["id"], "seq")


def snapshot(spark, **changes):
    values = {"entity_id": "2504009", "name": "X", "state": "PB", "score": 50.0, "risk_class": P.RISK_CLASSES[1],
              "score_base": 50.0, "score_raw": 50.0, "years_delivered": 6, "chronic_years": 0, **changes}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def publish(df, tmp_path):
    moment = datetime(2026, 5, 1, 12)
    run = H.Run("r1", date(2026, 5, 1), moment, "v8", pipeline_mode="full", notes="n")
    H.publish_snapshot(df, str(tmp_path / "s"), str(tmp_path / "log"), run)


def test_snapshot_day_is_replaced_and_run_logged(spark, tmp_path):
    publish(snapshot(spark), tmp_path)
    publish(snapshot(spark, score=60.0), tmp_path)
    assert [r.score for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [60.0]
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted(r.score_avg for r in log) == [50.0, 60.0]
    assert {(r.pipeline_mode, r.source_mode, r.notes, r.status) for r in log} == {("full", None, "n", "SUCCESS")}
    assert spark.read.parquet(str(tmp_path / "s")).columns.count("arrears_missing") == 1


def test_refused_snapshot_changes_nothing(spark, tmp_path):
    publish(snapshot(spark), tmp_path)
    with pytest.raises(ValueError, match="score_out_of_range"):
        publish(snapshot(spark, score=101.0), tmp_path)
    assert [r.score for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [50.0]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"score": 101.0}, "score_out_of_range"),
        ({"risk_class": "?"}, "unknown_class"),
        ({"entity_id": None}, "null_entity"),
        ({"state": "PBX"}, "bad_state"),
    ],
)
def test_bad_snapshots_are_refused(spark, tmp_path, changes, message):
    with pytest.raises(ValueError, match=message):
        publish(snapshot(spark, **changes), tmp_path)


def test_duplicate_and_empty_snapshots_are_refused(spark, tmp_path):
    one = snapshot(spark)
    with pytest.raises(ValueError, match="duplicate_entity=1"):
        publish(one.unionByName(one), tmp_path)
    with pytest.raises(ValueError, match="empty_snapshot=1"):
        publish(one.filter("false"), tmp_path)
    with pytest.raises(ValueError, match="snapshot lacks columns: score_raw"):
        publish(one.drop("score_raw"), tmp_path)


def test_history_views(spark, tables):
    H.create_views(S.snapshots(tables), "t")
    n = spark.sql("SELECT count(DISTINCT state, entity_id) FROM t_history").first()[0]
    assert spark.table("t_latest").count() == spark.table("t_diff_last_run").count() == n


def test_ranking_file(spark, tmp_path):
    header = ";".join(staging.RANKING_COLUMNS)
    body = "53;Distrito Federal - DF;DF;2024;180,5;1;2;3;4;97,2;A;1"
    (tmp_path / "r.csv").write_bytes(f"{header}\n{body}\n2504009;Água Branca - PB;pb;2024;-;;;;;70,1;;2\n".encode("latin-1"))
    raw = R.read_separated(spark, str(tmp_path), staging.RANKING_COLUMNS)
    got = {r.entity_code: r for r in staging.stage_ranking_file(raw).collect()}
    assert (got["5300108"].edition, got["5300108"].grade, got["5300108"].factor) == (2025, "A", 1.0)
    assert (got["2504009"].name, got["2504009"].state, got["2504009"].grade) == ("Água Branca", "PB", "D")


def test_sheets_need_a_header_row_but_not_near_the_top(spark):
    head = ["UF", "Cod.IBGE", "Município", "CAPAG"]
    rows = [("a", "capag", 60, 2020, head), ("a", "capag", 61, 2020, ["PB", "2504009", "X", "A"])]
    schema = "file string, sheet string, row_index long, year int, cells array<string>"
    assert [r.grade for r in R.discover_columns(spark.createDataFrame(rows, schema)).collect()] == ["A"]
    rows.append(("b", "capag", 0, 2020, ["PB", "2504009", "X", "A"]))
    with pytest.raises(Exception, match="no header row in b"):
        R.discover_columns(spark.createDataFrame(rows, schema)).collect()
    with pytest.raises(Exception, match="no header row in a"):
        R.discover_columns(spark.createDataFrame(rows[:2], schema), search_rows=40).collect()


def test_ranking_file_contract(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ID_ENTE;UF\n1;PB\n")
    with pytest.raises(ValueError, match="file lacks columns: .*NO_ICF"):
        R.read_separated(spark, str(tmp_path), staging.RANKING_COLUMNS)


def test_first_source_modes(spark, tmp_path):
    schema = "code string, n int"
    assert R.first_source(spark, [str(tmp_path / "none")], schema).count() == 0
    with pytest.raises(RuntimeError, match="no readable source"):
        R.first_source(spark, [str(tmp_path / "none")], schema, strict=True)
    (tmp_path / "a.csv").write_text("code,n\n0012,3\n")
    assert R.first_source(spark, ["missing", str(tmp_path / "a.csv")], schema).first().code == "0012"


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert {"entity_id", "score", "risk_class"} <= set(df.columns)
    assert df.count() > 0


def test_small_sides_of_a_join_are_hashed_instead_of_sorting_both(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(20_000).withColumn("x", F.col("id") + 1), spark.range(10_000).withColumn("y", F.col("id") + 2)
        joined = left.join(right, "id")
        joined.collect()
        assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_partitions_follow_the_tables(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.size_shuffles(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        with (tmp_path / "orders.parquet").open("wb") as file:
            file.truncate(session.INPUT_PER_PARTITION * (int(before) + 5))
        Tables(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == int(before) + 5
        Tables(spark, str(tmp_path / "orders.parquet"))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == int(before) + 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_lines_come_twice_from_one_pass_over_the_lines(spark):
    lines = spark.createDataFrame([(1, "PB", 5.5), (2, None, None), (1, "PB", 5.5)], "entity_id long, state string, value double")
    raw = S.raw_lines(lines)
    assert optimized(raw).count("LogicalRDD") == 1
    twice = S.as_text(lines.unionByName(lines.withColumn("value", F.col("value") - 1.0)))
    assert raw.schema.simpleString() == twice.schema.simpleString() and as_rows(raw) == as_rows(twice)


def test_raw_tables_share_one_join_of_orders_and_entities(spark):
    tables = Tables(spark, FOLDER)
    plans = [optimized(getattr(raw_inputs(tables), name)) for name in ("budget_lines", "fiscal_lines", "ratings", "accounts", "flags", "contracts")]
    assert not [plan for plan in plans if "o_custkey" in plan or "c_custkey" in plan]
    assert as_rows(S.owned_orders(tables)) == as_rows(S.owned_orders(Tables(spark, FOLDER)))


def test_contracts_staged_for_some_columns_are_those_of_whole_contracts(spark):
    """Versions that are equal up to one column, from the last that is read to the last of all, and nulls."""
    unit, body = '{"codigoIbge":"%s","municipioNome":"%s","ufSigla":"PB","nomeUnidade":"U"}', '{"cnpj":"%s","razaoSocial":"R"}'
    rows = [
        (key, "PB", "2001.0", month, modality, unit % (code, name), body % tax, "1", award, "2001-05-01T08:00", updated, no_data)
        for key, updated in (("a", "2001-06-01"), ("b", "2001-06-02"), ("c", None))
        for month, modality, code, name, tax, award, no_data in (
            ("5.0", "9", "7", "N", "2", "10.0", None), ("5.0", "9", "7", "M", "1", "10.0", None),
            ("5.0", "8", "7", "N", "1", "10.0", None), ("5.0", "8", "7", "N", "1", None, "False"),
            ("5.0", "8", "3", "Z", "9", "10.0", None), ("5.0", "8", "", "A", "0", "10.0", None), ("4.0", "9", "1", "B", "3", "7.0", "True"),
        )
    ]
    rows += [("b", "SE", "2001.0", "1.0", "9", None, None, "1", "4.0", "2001-05-02T08:00", "2001-06-01", None)]
    columns = ["contract_id", "state", "purchase_year", "month", "modality", "unit_json", "body_json", "estimated_value",
               "awarded_value", "published", "updated", "no_data"]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    some = staging.stage_contracts(raw, AGG_COLUMNS)
    whole = staging.stage_contracts(raw)
    assert as_rows(some) == as_rows(whole.select(AGG_COLUMNS)) and some.count() == 3
    assert "razaoSocial" in optimized(whole) and "razaoSocial" not in optimized(some)


def test_raw_ratings_are_staged_once(spark):
    ratings = score.staged_inputs(raw_inputs(Tables(spark, FOLDER))).ratings
    assert "row_number" not in optimized(ratings)
    assert as_rows(ratings.select("entity_id", "year", "percent")) == as_rows(S.ratings(Tables(spark, FOLDER)).select("entity_id", "year", "percent"))

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.operators import accounts as ACC
from riskspark.operators import annual as A
from riskspark.operators import flags as FL
from riskspark.operators import ranks as RK
from riskspark.operators.asof import asof_attach, asof_attach_sliced, attach_rating
from riskspark.operators.dedupe import keep_first
from riskspark.plans import history as H
from riskspark.plans import history_state as HS
from riskspark.plans import postprocess as PP
from riskspark.plans import staging
from riskspark.plans.postprocess import Window


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def average_rank(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.fixture(scope="module")
def pairs(spark):
    """Skewed pairs: one group and one score hold far more than a third of the rows."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if i % 10 < 7 else f"g{i % 3}"
        score = 50.0 if rng.random() < 0.4 else round(rng.uniform(0, 100), 2)
        outcome = round(max(0.0, rng.gauss(4 - score / 40, 2)), 2)
        rows.append((i % 200, group, "completa" if i % 4 else "parcial", score, outcome))
    return spark.createDataFrame(rows, "entity_id int, region string, era string, score double, outcome double"), rows


def test_median_spearman_auc_against_brute_force(pairs):
    df, rows = pairs
    keys = ["region", "score", "outcome"]
    counts = RK.pair_counts(df, keys)
    medians = {r.region: r.median for r in RK.group_median(counts, ["region"], "outcome").collect()}
    correlations = {r.region: r.spearman for r in RK.spearman(counts, ["region"], "score", "outcome").collect()}
    areas = {r.region: r.auc for r in RK.auc(counts, ["region"], "score", F.col("outcome") > 3).collect()}
    for region in {r[1] for r in rows}:
        score = np.array([r[3] for r in rows if r[1] == region])
        outcome = np.array([r[4] for r in rows if r[1] == region])
        assert medians[region] == pytest.approx(np.median(outcome))
        expected = np.corrcoef(average_rank(score), average_rank(outcome))[0, 1]
        assert correlations[region] == pytest.approx(expected, abs=6e-5)
        event = outcome > 3
        wins = sum((100 - p > 100 - n) + 0.5 * (p == n) for p in score[event] for n in score[~event])
        assert areas[region] == pytest.approx(wins / (event.sum() * (~event).sum()), abs=6e-5)


def test_results_do_not_depend_on_partitioning(pairs):
    df, _ = pairs
    first = as_rows(RK.metrics_by_group(df.repartition(1), "region"))
    assert first == as_rows(RK.metrics_by_group(df.repartition(7, "score"), "region"))


def test_small_group_metrics(spark):
    rows = [(1, "a", "completa", 10.0, 5.0), (2, "a", "completa", 20.0, 1.0)]
    df = spark.createDataFrame(rows, "entity_id int, region string, era string, score double, outcome double")
    row = RK.metrics_by_group(df, "region").first()
    assert (row.base, row.n_pairs, row.spearman, row.auc, row.reading) == (P.BASE_TOTAL, 2, None, None, P.READ_TOO_SMALL)


def test_student_tail_matches_known_quantiles(spark):
    # Two-sided 5 % points of Student's t for 1, 10, 1000 and very many degrees of freedom.
    points = [(12.706205, 1.0), (2.228139, 10.0), (1.962339, 1000.0), (1.959964, 1e9)]
    rows = spark.createDataFrame([(s * t, d) for t, d in points for s in (1, -1)], "t double, d double")
    for row in rows.select(RK.student_tail(F.col("t"), F.col("d")).alias("p")).collect():
        assert row.p == pytest.approx(0.05, abs=1e-6)


def test_value_slices_never_fall(spark):
    rng = random.Random(4)
    values = sorted([0.0, 1e-300, -1e-300, 1.0, 2.0, 4.0, 0.1, 1e18] + [s * 10 ** rng.uniform(-14, 14) for s in (1, -1) for _ in range(400)])
    slices = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(RK.value_slice(F.col("v"))).collect()]
    assert slices == sorted(slices) and len(set(slices)) > 700


def test_null_groups_are_groups(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 5.0), (None, 1.0, 9.0), (None, 2.0, 1.0)]
    counts = RK.pair_counts(spark.createDataFrame(rows, "g string, x double, y double"), ["g", "x", "y"])
    assert as_rows(RK.spearman(counts, ["g"], "x", "y")) == [("a", 2, 1.0), (None, 2, -1.0)]
    assert {r.g: r.auc for r in RK.auc(counts, ["g"], "x", F.col("y") > 3).collect()} == {"a": 0.0, None: 1.0}


def test_default_ratings_and_years_off_the_grid(spark):
    columns = ("entity_id long, state string, year long, in_grid boolean, has_budget boolean, has_fiscal boolean,"
               " revenue_planned double, revenue_realized double, arrears_pct double, rating_factor double,"
               " rating_preliminary boolean, rating_stale boolean, rating_missing boolean")  # fmt: skip

    def row(entity, state, year, in_grid, pct, factor):
        return (entity, state, year, in_grid, True, False, 1.0, 1.0, pct, factor, False, False, False)

    rows = [row(1, "PB", 2024, True, 1.0, 1.0), row(1, "PB", 2023, False, 1.0, 0.8), row(2, "PB", 2024, True, None, 0.9),
            row(3, "CE", 2024, True, None, 0.9), row(4, None, 2024, False, 1.0, 0.9)]
    got = {r.entity_id: tuple(r)[1:] for r in PP.arrears_rating(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: (1.0, False, False, False), 3: (0.8, False, False, True)}


def test_periods_that_are_all_null_give_no_budget_row(spark, lines):
    blank = lines.withColumn("period", F.lit(None).cast("int")).withColumn("entity_id", F.lit(9).cast("long"))
    assert ACC.budget_pivot(lines.unionByName(blank)).filter("entity_id = 9").count() == 0


@pytest.fixture(scope="module")
def snapshots(spark):
    """A hot entity with 400 of 520 snapshots, runs of severe flags and repeated timestamps."""
    rng = random.Random(9)
    rows, start = [], datetime(2026, 1, 1)
    for i in range(520):
        entity = "hot" if i < 400 else f"e{i % 7}"
        severe = 2 if rng.random() < 0.85 else (0 if rng.random() < 0.7 else None)
        state = None if i % 50 == 0 else "PB"
        rows.append((f"r{i:04d}", start + timedelta(minutes=rng.randrange(0, 4000)), state, entity, severe, float(i % 100)))
    return spark.createDataFrame(
        rows, "run_id string, snapshot_ts timestamp, state string, entity_id string, n_severe int, score double"
    )


@pytest.mark.parametrize("block_rows", [12, 25, 1000])
def test_persistence_in_blocks_equals_one_window(snapshots, block_rows):
    got = H.flag_persistence(snapshots, (6, 12), block_rows)
    for n in (6, 12):
        column = f"n_severe_last_{n}"
        expected = H.plain_window_persistence(snapshots, n).select("run_id", column)
        assert as_rows(got.select("run_id", column)) == as_rows(expected)
    assert got.count() == snapshots.count()
    full = got.filter("entity_id = 'hot' AND state = 'PB'").orderBy("snapshot_ts", "run_id").collect()
    flags = [bool(r.has_severe) for r in full]
    assert [r.persistent_6 for r in full] == [i >= 5 and all(flags[i - 5 : i + 1]) for i in range(len(flags))]


def test_persistence_rejects_blocks_smaller_than_the_frame(snapshots):
    with pytest.raises(ValueError, match="whole frame"):
        H.flag_persistence(snapshots, (6, 12), 11)


def line(entity, year, period, measure, value, annex=None):
    prefix, codes, column, name = P.BUDGET_RULES[measure]
    labels = {
        "revenue_realized": "Até o Bimestre (c)",
        "revenue_planned": "PREVISÃO ATUALIZADA (a)",
        "processed_arrears": "Saldo e = (a+ b) - (c + d)",
    }
    return (entity, "PB", "X", year, period, "B", annex or prefix, "M", labels[measure], codes[0],
            "TOTAL (III) = (I + II)" if name else "R", value, 10)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        line(1, 2024, 1, "revenue_realized", 10.0),
        line(1, 2024, 6, "revenue_realized", 90.0),
        line(1, 2024, 6, "revenue_realized", 95.0),  # repeated line: the larger value stays
        line(1, 2024, 6, "revenue_planned", 100.0),
        line(1, 2024, 3, "processed_arrears", 7.0),  # older period: no longer counts
        line(2, 2024, 2, "revenue_planned", 50.0, "RREO-Anexo 01 - X"),
        line(2, 2024, 2, "revenue_realized", 50.0, "RREO-Anexo 02"),
    ]
    schema = ", ".join(f"{name} {kind}" for name, kind in staging.LINE_TYPES.items())
    order = ["entity_id", "state", "institution", "year", "period", "regime", "annex", "sphere", "column_label",
             "account_code", "account_name", "value", "population"]
    assert list(staging.LINE_TYPES) == order
    return spark.createDataFrame(rows, schema)


def test_pivot_takes_the_last_period_and_ignores_repeats(lines):
    got = {r.entity_id: r for r in ACC.budget_pivot(lines).collect()}
    assert (got[1].revenue_realized, got[1].revenue_planned, got[1].processed_arrears) == (95.0, 100.0, None)
    assert (got[2].revenue_planned, got[2].revenue_realized) == (50.0, None)


def test_pivot_needs_no_dedupe(lines):
    assert as_rows(ACC.budget_pivot(lines)) == as_rows(ACC.budget_pivot(staging.stage_budget_lines(lines)))


def test_periods_of_repeated_lines_are_those_of_staged_lines(spark, lines):
    moved = lines.withColumn("state", F.lit("PB")).withColumn("value", F.col("value") - F.col("entity_id") + 1.5)
    unknown = lines.filter("entity_id = 2").withColumn("state", F.lit("XX")).withColumn("value", F.col("value") + 9)
    stateless = lines.filter("period = 6").withColumns({"state": F.lit(None).cast("string"), "period": F.lit(None).cast("int")})
    for rows in (lines, lines.union(moved), lines.union(moved).union(unknown).union(stateless).union(stateless)):
        staged = ACC.budget_periods(staging.stage_budget_lines(rows))
        assert as_rows(staging.staged_budget_periods(staging.typed_lines(rows))) == as_rows(staged)
        fiscal = rows.withColumns({"annex": F.lit(P.FISCAL_ANNEX), "account_code": F.lit(P.CASH_AFTER)})
        records = ACC.fiscal_records(staging.stage_fiscal_lines(fiscal))
        assert as_rows(staging.staged_fiscal_records(staging.typed_lines(fiscal))) == as_rows(records)
    unread = staging.typed_lines(lines.withColumn("population", F.lit("many")))
    for job in (staging.staged_budget_periods, staging.staged_fiscal_records):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            job(unread).collect()


def test_repeated_lines_are_not_shuffled_one_by_one(spark, lines):
    plan = staging.staged_fiscal_records(lines.union(lines))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_asof_uses_newest_earlier_rating(spark):
    targets = spark.createDataFrame([(1, y) for y in range(2019, 2025)] + [(2, 2020)], "entity_id long, year long")
    ratings = spark.createDataFrame(
        [(1, 2020, "FINAL", "A", 1.0), (1, 2023, "PREVIO_OFICIAL", "C", 0.9), (3, 2020, "FINAL", "A", 1.0)],
        "entity_id long, year long, status string, grade string, factor double",
    )
    got = {(r.entity_id, r.year): r for r in attach_rating(targets, ratings).collect()}
    assert len(got) == 7
    assert (got[1, 2019].rating_factor, got[1, 2019].rating_missing, got[1, 2019].rating_grade) == (0.8, True, "SEM_ICF")
    assert (got[1, 2020].rating_stale, got[1, 2022].rating_stale, got[1, 2022].rating_year) == (False, True, 2020)
    assert (got[1, 2024].rating_preliminary, got[1, 2024].rating_factor) == (True, 0.9)
    assert got[2, 2020].rating_missing


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_sliced_asof_equals_the_plain_window(spark, width):
    rng = random.Random(4)
    times = [None, *range(-50, 300)]
    # one entity holds most rows, some rows have no entity, points in time repeat on both sides
    keys = [1] * 8 + [2, 3, None]
    left = [(n, rng.choice(keys), rng.choice(times)) for n in range(1500)]
    right = [(rng.choice(keys), rng.choice(times), rng.choice([None, rng.random()]), n) for n in range(400)]
    left = spark.createDataFrame(left, "n long, k long, t long")
    right = spark.createDataFrame(right, "k long, t long, x double, m long")
    sliced = asof_attach_sliced(left, right, ["k"], "t", ["x", "m"], lambda t: F.floor(t / width))
    assert as_rows(sliced) == as_rows(asof_attach(left, right, "k", "t", ["x", "m"]))
    assert asof_attach_sliced(left.limit(0), right, ["k"], "t", ["x"], lambda t: t).count() == 0
    assert asof_attach_sliced(left, right.limit(0), ["k"], "t", ["x"], lambda t: t).filter("x IS NULL").count() == 1500


def test_state_of_newest_snapshots_follows_the_history(spark, tmp_path):
    rng = random.Random(6)
    path = str(tmp_path / "state")
    schema = "run_id string, snapshot_ts timestamp, snapshot_date date, state string, entity_id string, score double, risk_class string, n_severe long, compliance_risk double"
    history: dict = {}
    for step in range(40):
        day = date(2026, 1, 1) + timedelta(days=step if step % 5 else max(0, step - 3))  # now and then a day again
        for state in ("PB", "CE") if step % 4 else ("PB",):
            moment = datetime(day.year, day.month, day.day, 12)
            entities = [e for e in range(12) if rng.random() < 0.9]  # an entity may be missing from a repeated day
            history[day, state] = [
                (f"r{step}", moment, day, state, str(e), rng.random(), rng.choice("ab"), rng.choice([0, 1, 1, 1, None]), 0.5) for e in entities
            ]
        new = [r for state in ("PB", "CE") if step % 4 or state == "PB" for r in history[day, state]]
        if step % 8 == 7 or step > 30:
            every = spark.createDataFrame([r for rows in history.values() for r in rows], schema).coalesce(2)
            published = every if step <= 31 else spark.createDataFrame(new, schema).coalesce(2)
            HS.update_state(published, every, path)
            if step in (7, 31, 35, 39):
                state = HS.read_state(spark, path)
                names = H.diff_last_run(every).columns
                assert as_rows(HS.diff_from_state(state).select(names)) == as_rows(H.diff_last_run(every))
                columns = ["run_id", "state", "entity_id", "n_severe_last_6", "n_severe_last_12", "persistent_6", "persistent_12", "has_severe"]
                full = keep_first(H.flag_persistence(every), H.ENTITY, [F.col("snapshot_ts").desc(), F.col("run_id").desc()])
                assert as_rows(HS.persistence_from_state(state).select(columns)) == as_rows(full.select(columns))
                assert as_rows(HS.latest_from_state(state).select("run_id", "entity_id")) == as_rows(H.latest(every).select("run_id", "entity_id"))


def test_weighted_recency_ignores_the_open_year(spark):
    rows = spark.createDataFrame([(1, 2025, 100.0), (1, 2026, 15.0)], "entity_id long, year long, x double")
    weight = A.recency_weight(F.col("year"), 2025, 2021)
    aggs = A.weighted_recency_aggs(F.col("x"), weight, "mean", with_rating=False)
    assert rows.groupBy("entity_id").agg(*aggs).first().mean == 100.0


def test_weighted_recency_null_measure(spark):
    rows = spark.createDataFrame([(1, 2025, 100.0), (1, 2024, None)], "entity_id long, year long, x double")
    weight = A.recency_weight(F.col("year"), 2025, 2021)
    keep = A.weighted_recency_aggs(F.col("x"), weight, "kept", with_rating=False)
    skip = A.weighted_recency_aggs(F.col("x"), weight, "skipped", skip_null_weights=True, with_rating=False)
    row = rows.groupBy("entity_id").agg(*keep, *skip).first()
    assert (row.kept, row.skipped) == (round(40 / 0.65, 6), 100.0)


def test_coverage_counts(spark):
    window = Window(date(2026, 5, 1), 2021)
    base = spark.createDataFrame(
        [(1, y, True, 1.0) for y in range(2021, 2026)] + [(2, 2024, True, None)],
        "entity_id long, year long, has_budget boolean, revenue_planned double",
    )
    spine = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    got = A.spine_counts(spine, base, window.start_year, window.end_year)
    assert as_rows(got.select("entity_id", "years_delivered", "coverage")) == [(1, 5, 5 / 6), (2, 0, 0.0), (3, 0, 0.0)]


def test_first_match_prefers_the_wanted_column(spark):
    rows = [
        (1, 1, "Receita", "Outra", "15"), (1, 2, " receita ", "Valor", "11"), (2, 1, "Receita", "Outra", "42"),
        (3, 1, "Receita", "Valor", ""), (4, 1, "Receita", "Valor", "x"), (4, 2, "Receita", "Outra", "3"),
        (5, 1, "Receita", "Outra", "x"), (5, 2**41, "Receita", "Outra", "8"), (5, 2**42, "Receita", "Outra", "9"),
        (6, 2**43, "Receita", "Valor", "7"), (6, 1, "Receita", None, "5"),
    ]
    df = spark.createDataFrame(rows, "entity_id long, seq long, account_name string, column_label string, value string")
    got = {r.entity_id: r.first_value for r in ACC.first_match(df, ["entity_id"], "Valor").collect()}
    assert got == {1: 11.0, 2: 42.0, 3: 0.0, 4: None, 5: 8.0, 6: 7.0}


def test_flags_row(spark):
    clean = {c: "2026-01-01" for c in P.REQUIREMENT_COLUMNS}
    rows = [
        {"entity_id": 1, **clean},
        {"entity_id": 2, **clean, "req_cadin": "!"},
        {"entity_id": 3, **clean, "req_fgts": " ", "req_siga": None},
    ]
    schema = "entity_id long, " + ", ".join(f"{c} string" for c in P.REQUIREMENT_COLUMNS)
    df = spark.createDataFrame([tuple(r[c] for c in ["entity_id", *P.REQUIREMENT_COLUMNS]) for r in rows], schema)
    got = {r.entity_id: r for r in FL.flags_severity(df).collect()}
    assert (got[1].pending_text, got[1].pending_json, got[1].compliance_risk) == ("REGULAR", "[]", 0.0)
    assert (got[2].pending_text, got[2].n_severe, got[2].compliance_risk) == ("CADIN", 1, 1.0)
    assert (got[3].pending_text, got[3].compliance_risk) == ("Regularidade FGTS | SIGA (Alimentação Escolar)", 0.15)

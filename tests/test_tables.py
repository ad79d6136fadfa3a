"""Tables that survive: merges, slices, exports and readers, with jobs that die at every step."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskspark.operators.quality import Watch
from riskspark.plans import staging
from riskspark.sinks import storage
from riskspark.sinks import tables as K
from riskspark.sources import files as R
from riskspark.streaming import incremental as X


class Killed(Exception):
    pass


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ledger(spark, rows):
    return spark.createDataFrame(rows, "id long, state string, year int, v string, seq long")


def values(spark, path):
    return dict(as_rows(K.read_upserted(spark, path).select("id", "v")))


ROWS = [(i, "PB", 2024, "a", 1) for i in range(1000)]
CHANGE = [(i, "PB", 2024, "b", 2) for i in (3, 5, 2000, 2001)]
AFTER = {**{r[0]: "a" for r in ROWS}, **{r[0]: "b" for r in CHANGE}}


# --- upsert ------------------------------------------------------------------------------


def notes(folder):
    return sorted(f for f in folder.iterdir() if f.name.startswith(storage.NOTE))


def test_a_lost_note_fails_instead_of_emptying_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, ROWS), path, ["id"], "seq", buckets=4)
    kept = {note: note.read_bytes() for note in notes(tmp_path / "t")}
    for note in kept:
        note.unlink()
    with pytest.raises(ValueError, match="holds data but no note"):
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq", buckets=4)
    with pytest.raises(ValueError, match="holds data but no note"):
        K.read_upserted(spark, path)
    for note, body in kept.items():
        note.write_bytes(body)
        (note.parent / f".{note.name}.crc").unlink(missing_ok=True)
    K.upsert(ledger(spark, CHANGE), path, ["id"], "seq")
    assert values(spark, path) == AFTER


def test_a_half_written_note_and_a_foreign_folder_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, ROWS), path, ["id"], "seq", buckets=4)
    note = notes(tmp_path / "t")[-1]
    note.write_bytes(note.read_bytes()[:50])
    (note.parent / f".{note.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="is damaged"):
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq")
    ledger(spark, ROWS).write.parquet(str(tmp_path / "foreign"))
    with pytest.raises(ValueError, match="holds data but no note"):
        K.upsert(ledger(spark, CHANGE), str(tmp_path / "foreign"), ["id"], "seq")
    assert spark.read.parquet(str(tmp_path / "foreign")).count() == len(ROWS)


@pytest.mark.parametrize("step", ["merge_rows", "list_dirs", "write_note", "remove", "sweep"])
def test_an_upsert_that_dies_at_any_step_loses_no_row(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, ROWS), path, ["id"], "seq", buckets=4)

    def die(*_args, **_kwargs):
        raise Killed(step)

    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(K, step, die)
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq", batch_id=("s", 0))
    held = values(spark, path)
    assert held == ({r[0]: "a" for r in ROWS} if step in ("merge_rows", "list_dirs", "write_note") else AFTER)
    for _ in range(3):
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq", batch_id=("s", 0))
        assert values(spark, path) == AFTER


@pytest.mark.parametrize("step", ["claim", "list_dirs", "write_note", "sweep"])
def test_a_first_load_that_died_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")

    def die(*_args, **_kwargs):
        raise Killed(step)

    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(K, step, die)
        K.upsert(ledger(spark, ROWS), path, ["id"], "seq", buckets=4)
    for _ in range(2):
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq", buckets=4)
        assert values(spark, path) == (AFTER if step == "sweep" else {r[0]: "b" for r in CHANGE})


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for number, rows in enumerate((ROWS, CHANGE, [(3, "PB", 2024, "c", 3)])):
        K.upsert(ledger(spark, rows), path, ["id"], "seq", buckets=4, batch_id=("s", number))
    files = sorted(f.name for f in (tmp_path / "t").rglob("*"))
    for number, rows in ((0, ROWS), (1, CHANGE), (2, [(3, "PB", 2024, "z", 9)])):
        K.upsert(ledger(spark, rows), path, ["id"], "seq", batch_id=("s", number))
        assert sorted(f.name for f in (tmp_path / "t").rglob("*")) == files
    K.upsert(ledger(spark, [(3, "PB", 2024, "other", 1)]), path, ["id"], "seq", batch_id=("another source", 0))
    assert values(spark, path) == {**AFTER, 3: "other"}


def test_a_table_keeps_one_older_load_and_three_notes(spark, tmp_path):
    path = str(tmp_path / "t")
    reader = None
    for number in range(6):
        K.upsert(ledger(spark, [(r[0], "PB", 2024, str(number), number) for r in ROWS]), path, ["id"], "seq", buckets=4)
        if reader is not None:
            assert {r.v for r in reader.collect()} == {str(number - 1)}  # a reader that began before the load
        reader = K.read_upserted(spark, path)
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("load-")]) == 2
    assert len(notes(tmp_path / "t")) == 3


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    K.upsert(ledger(spark, ROWS), path, ["id"], "seq", buckets=4)
    merge = K.merge_rows

    def meanwhile(*args):
        monkeypatch.setattr(K, "merge_rows", merge)
        K.upsert(ledger(spark, [(7, "PB", 2024, "other", 5)]), path, ["id"], "seq")
        return merge(*args)

    monkeypatch.setattr(K, "merge_rows", meanwhile)
    with pytest.raises(ValueError, match="another job wrote"):
        K.upsert(ledger(spark, CHANGE), path, ["id"], "seq")
    assert values(spark, path) == {**{r[0]: "a" for r in ROWS}, 7: "other"}


def counted(spark, df):
    """The frame with a column whose evaluations are counted."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def mark(value):
        seen.add(1)
        return value

    return df.withColumn("v", mark.asNondeterministic()("v")), seen


def test_a_checked_batch_is_evaluated_once(spark, tmp_path):
    writes = {
        "upsert": lambda df: K.upsert(df, str(tmp_path / "u"), ["id"], "seq", newest=[F.col("year").desc()]),
        "replace": lambda df: K.replace_slice(df, str(tmp_path / "r"), ["id"], ["year"], "seq", state="PB"),
        "append": lambda df: K.append_slice(df, str(tmp_path / "a"), ["id"], ["year"], "seq", state="PB"),
    }
    for name, write in writes.items():
        for _ in range(2):
            batch, seen = counted(spark, ledger(spark, ROWS))
            write(batch)
            assert seen.value == len(ROWS), name


def test_watched_checks_of_bad_and_empty_batches(spark, tmp_path):
    bad = ledger(spark, [(None, "PB", 2024, "a", 1), (2, "CE", 2024, "a", 1), (3, " ", 2024, "a", 1)])
    for k, write in enumerate((K.replace_slice, K.append_slice)):
        path = str(tmp_path / f"t{k}")
        with pytest.raises(ValueError, match="blank_id=1; blank_state=1; foreign_state=2"):
            write(bad, path, ["id"], ["year"], "seq", state="PB")
        write(ledger(spark, []), path, ["id"], ["year"], "seq")
        assert not [f for f in (tmp_path / f"t{k}").rglob("*.parquet")]
    with pytest.raises(ValueError, match="blank_id=1"):
        K.upsert(bad, str(tmp_path / "u"), ["id"], "seq")
    K.upsert(ledger(spark, []), str(tmp_path / "u"), ["id"], "seq")
    assert K.read_upserted(spark, str(tmp_path / "u")).count() == 0
    watch = Watch(bad, {"old": F.col("year") < 2000})
    watch.rows.write.parquet(str(tmp_path / "w"))
    assert watch.raise_on_violations(spark.read.parquet(str(tmp_path / "w"))) == 3


# --- plain tables and partition folders --------------------------------------------------


def test_a_failing_truncate_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    K.append_rows(ledger(spark, ROWS[:100]), path)
    with pytest.raises(Exception, match="no such luck"):
        K.append_rows(ledger(spark, CHANGE).withColumn("v", F.raise_error(F.lit("no such luck"))), path, truncate=True)
    assert spark.read.parquet(path).count() == 100
    K.append_rows(ledger(spark, CHANGE), path, truncate=True)
    assert spark.read.parquet(path).count() == len(CHANGE)
    # a job that died between its two renames: the old folder stands aside
    (tmp_path / "t").rename(tmp_path / f"t{storage.REPLACED}")
    K.append_rows(ledger(spark, ROWS[:1]), path)
    assert spark.read.parquet(path).count() == len(CHANGE) + 1
    assert sorted(f.name for f in tmp_path.iterdir() if f.is_dir()) == ["t"]


def test_a_swap_that_died_is_made_good(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "PB", 2023, "a", 1), (2, "PB", 2024, "b", 1), (3, "CE", 2024, "c", 1)]
    K.replace_slice(ledger(spark, rows), path, ["id"], ["year"], "seq")
    aside = tmp_path / "t" / f"{storage.ASIDE}x" / "state=PB"
    aside.mkdir(parents=True)
    (tmp_path / "t" / "state=PB" / "year=2024").rename(aside / "year=2024")  # moved aside, nothing in its place
    K.replace_slice(ledger(spark, [(9, "CE", 2024, "z", 1)]), path, ["id"], ["year"], "seq")
    assert as_rows(spark.read.parquet(path).select("id", "v")) == [(1, "a"), (2, "b"), (9, "z")]
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("_")]


# --- loads -------------------------------------------------------------------------------

LOAD_SCHEMA = "id bigint, state string, year bigint, price double, seq bigint, load_id bigint"


def arrive(spark, folder, load, rows, files):
    frame = spark.createDataFrame([(i, s, y, p, 0, load) for i, s, y, p in rows], LOAD_SCHEMA)
    frame.repartition(files).write.mode("append").json(str(folder / "in"))


def announce(spark, folder, load, rows, less=0):
    frame = spark.createDataFrame(rows, "id long, state string, year long, price double")
    told = frame.groupBy("state", "year").agg((F.countDistinct("id") - less).alias("expected_rows"))
    told.withColumn("load_id", F.lit(load)).coalesce(1).write.mode("append").json(str(folder / "markers"))


def replace_new(spark, folder, **options):
    X.incremental_replace_slice(
        spark, str(folder / "in"), LOAD_SCHEMA, str(folder / "t"), str(folder / "cp"), ["id"], ["year"], "seq", "load_id",
        str(folder / "markers"), **options,
    )
    if not (folder / "t").exists():
        return {}
    return dict(as_rows(spark.read.parquet(str(folder / "t")).select("id", "price")))


FIRST = [(i, "PB" if i % 2 else "CE", 2020 + i % 2, 1.0) for i in range(40)]
SECOND = [(i, "PB", 2021, 2.0) for i in range(1, 40, 2)]


def prices(rows):
    return {i: p for i, _, _, p in rows}


@pytest.mark.parametrize("files_per_batch", [1, 3, None])
def test_a_load_shows_only_when_it_is_complete(spark, tmp_path, files_per_batch):
    arrive(spark, tmp_path, 1, FIRST, 4)
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == {}  # not announced yet
    announce(spark, tmp_path, 1, FIRST)
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == prices(FIRST)
    announce(spark, tmp_path, 2, SECOND)
    arrive(spark, tmp_path, 2, SECOND[:10], 2)
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == prices(FIRST)
    arrive(spark, tmp_path, 2, SECOND[:10], 2)  # the same rows again are no further rows
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == prices(FIRST)
    arrive(spark, tmp_path, 2, SECOND[10:], 2)
    after = {**prices(FIRST), **prices(SECOND)}
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == after
    files = sorted(f.name for f in (tmp_path / "t").rglob("*.parquet"))
    arrive(spark, tmp_path, 2, [(1, "PB", 2021, 9.0)], 1)  # a published load, repeated
    arrive(spark, tmp_path, 1, [(99, "PB", 2021, 9.0)], 1)  # an older load, late
    announce(spark, tmp_path, 2, SECOND)
    assert replace_new(spark, tmp_path, files_per_batch=files_per_batch) == after
    assert sorted(f.name for f in (tmp_path / "t").rglob("*.parquet")) == files


def test_an_older_load_shows_while_the_newest_is_incomplete(spark, tmp_path):
    for load, part in ((1, SECOND), (2, SECOND), (3, SECOND[:5])):
        rows = [(i, s, y, float(load)) for i, s, y, _ in part]
        arrive(spark, tmp_path, load, rows, 2)
        announce(spark, tmp_path, load, SECOND)
    assert set(replace_new(spark, tmp_path).values()) == {2.0}


def test_a_run_without_new_files_reads_no_table(spark, tmp_path):
    arrive(spark, tmp_path, 1, FIRST, 2)
    announce(spark, tmp_path, 1, FIRST)
    replace_new(spark, tmp_path)
    for folder in ("t", "cp-landing", "cp-ledger"):
        for file in (tmp_path / folder).rglob("*.parquet"):
            file.write_bytes(b"unreadable")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    X.incremental_replace_slice(
        spark, str(tmp_path / "in"), LOAD_SCHEMA, str(tmp_path / "t"), str(tmp_path / "cp"), ["id"], ["year"], "seq", "load_id",
        str(tmp_path / "markers"),
    )


@pytest.mark.parametrize("step", ["replace_slice", "write_note"])
def test_a_settlement_that_died_is_repeated(spark, tmp_path, monkeypatch, step):
    arrive(spark, tmp_path, 1, FIRST, 2)
    announce(spark, tmp_path, 1, FIRST)

    def die(*_args, **_kwargs):
        raise Killed(step)

    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(X, step, die)
        replace_new(spark, tmp_path)
    assert replace_new(spark, tmp_path) == prices(FIRST)  # no new file since


def test_the_ledger_holds_open_loads_and_the_published_one(spark, tmp_path):
    for load in range(1, 5):
        arrive(spark, tmp_path, load, SECOND, 1)
        announce(spark, tmp_path, load, SECOND)
        replace_new(spark, tmp_path)
    arrive(spark, tmp_path, 5, SECOND[:3], 1)
    arrive(spark, tmp_path, 2, SECOND[:3], 1)
    replace_new(spark, tmp_path)
    loads = X.SliceLoads(spark, str(tmp_path / "cp"), {"state": "string", "year": "bigint"}, "load_id")
    rows = as_rows(loads.held(loads.news()[1]).select("load_id", "_landed", "_expected", "_rows"))
    assert rows == [(4, 20, 20, 20), (5, 3, None, None)]


@pytest.mark.parametrize(
    ("row", "load", "message"),
    [((2, None, 2020, 1.0), 1, "blank_state=1"), ((2, "PB", None, 1.0), 1, "blank_year=1"),
     ((2, "PB", 2020, 1.0), None, "blank_load_id=1"), ((None, "PB", 2020, 1.0), 1, "blank_key=1")],
)
def test_a_landed_row_without_key_state_slice_or_load_fails_the_job(spark, tmp_path, row, load, message):
    arrive(spark, tmp_path, 1, [(1, "PB", 2020, 1.0)], 1)
    arrive(spark, tmp_path, load, [row], 1)
    for _ in range(2):
        with pytest.raises(ValueError, match=message):
            replace_new(spark, tmp_path)


def test_markers_that_contradict_the_rows_or_themselves_fail_the_job(spark, tmp_path):
    arrive(spark, tmp_path, 1, SECOND, 1)
    announce(spark, tmp_path, 1, SECOND, less=1)
    with pytest.raises(ValueError, match="more rows landed"):
        replace_new(spark, tmp_path)
    announce(spark, tmp_path, 1, SECOND)
    with pytest.raises(ValueError, match="clashing_markers=1"):
        replace_new(spark, tmp_path)


def test_a_bad_line_fails_a_load_unless_told_to_skip(spark, tmp_path):
    arrive(spark, tmp_path, 1, [(1, "PB", 2020, 1.0)], 1)
    announce(spark, tmp_path, 1, [(1, "PB", 2020, 1.0)])
    (tmp_path / "in" / "bad.json").write_text('{"id": 2, "state"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        replace_new(spark, tmp_path)
    assert replace_new(spark, tmp_path, bad_lines=X.SKIP) == {1: 1.0}


# --- readers and exports -----------------------------------------------------------------


def test_a_sorted_export_into_many_files_is_marked_and_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("id"), F.lit("é;x").alias("text")).repartition(6)
    with_partitions = frame.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.export_csv(frame, path, [F.col("id")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_partitions)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 1
    assert as_rows(K.marked_files(spark, path).groupBy("has_mark").count()) == [(True, len(files))]
    plain = [(k, i, line) for k, f in enumerate(files) for i, line in enumerate(f.read_text("utf-8-sig").splitlines())]
    for block in (None, "2000"):  # whole files and blocks of files
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            got = R.number_lines(spark, path).orderBy("line").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.file_number, r.line_of_file, r.value) for r in got] == plain
        assert [r.line for r in got] == list(range(len(plain)))
    ids = [int(line.split(",")[0]) for _, _, line in plain if not line.startswith("id,")]
    assert ids == list(range(3000))
    (tmp_path / "out" / files[0].name).write_text("no mark\n")
    (tmp_path / "out" / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert K.marked_files(spark, path).filter("NOT has_mark").count() == 1


def test_a_folder_with_good_and_bad_files_is_reported_by_file(spark, tmp_path):
    rows = ledger(spark, [(i, "PB", 2024, "a", 1) for i in range(10)])
    base = tmp_path / "s"
    for k, (state, frame) in enumerate((("PB", rows), ("PB", rows.drop("v")), ("CE", rows.drop("v", "year")), ("PB", rows.withColumn("extra", F.lit(1))))):
        frame.drop("state").coalesce(1).write.mode("append").parquet(str(base / f"state={state}"))
        assert k >= 0
    union, skipped = R.union_state_files(spark, str(base), ["id", "v", "year"])
    assert union.count() == 20 and union.filter("v IS NULL").count() == 0
    assert as_rows(union.groupBy("state", "extra").count()) == [("PB", 1, 10), ("PB", None, 10)]
    assert sorted((f.state, f.missing) for f in skipped) == [("CE", ("v", "year")), ("PB", ("v",))]
    assert all(f"state={f.state}" in f.file for f in skipped)
    with pytest.raises(ValueError, match="no state file meets"):
        R.union_state_files(spark, str(base), ["none"])


def preamble_file(folder, name, day, rows, encoding="utf-8"):
    lines = [f'"Data da Pesquisa: {day}"', '"Fonte: Tesouro"', "", 'UF;"Nome";"Código IBGE";"1.1"', *rows]
    (folder / name).write_bytes("\n".join(lines).encode(encoding))


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_the_plan_of_many_files_is_no_larger(spark, tmp_path):
    (tmp_path / "few").mkdir()
    (tmp_path / "many").mkdir()
    for k in range(60):
        for folder in ("few", "many") if k < 2 else ("many",):
            encoding = "latin-1" if k % 2 else "utf-8"
            preamble_file(tmp_path / folder, f"f{k}.csv", f"{k % 28 + 1:02d}/11/2001", [f"PB;São {k};{k};x"], encoding)
    few, many = (R.read_preamble_csv(spark, str(tmp_path / n)) for n in ("few", "many"))
    got = {int(r["Código IBGE"]): (r.survey_date, r["Nome"]) for r in many.collect()}
    assert got == {k: (f"{k % 28 + 1:02d}/11/2001", f"São {k}") for k in range(60)}
    assert plan_size(many) < 1.3 * plan_size(few)


def test_files_of_different_headers_are_refused(spark, tmp_path):
    preamble_file(tmp_path, "a.csv", "01/11/2001", ["PB;a;1;x"])
    (tmp_path / "b.csv").write_text("UF;IBGE;other\nPB;1;x\n")
    with pytest.raises(ValueError, match="expected one common header line"):
        R.read_preamble_csv(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("nothing here\n")
    with pytest.raises(ValueError, match="found none"):
        R.read_separated(spark, str(tmp_path / "c"), staging.RANKING_COLUMNS)


def test_a_file_without_searched_rows_fails_by_name(spark):
    head = ["UF", "Cod.IBGE", "Município", "CAPAG"]
    body = ["PB", "2504009", "X", "A"]
    schema = "file string, sheet string, row_index long, year int, cells array<string>"
    rows = [("a", "capag", 60, 2020, head), ("a", "capag", 61, 2020, body), ("c", "capag", 0, 2020, head), ("c", "capag", 1, 2020, body)]
    assert R.discover_columns(spark.createDataFrame(rows, schema)).count() == 2
    with pytest.raises(Exception, match="no header row in a"):
        R.discover_columns(spark.createDataFrame(rows, schema), search_rows=40).collect()
    nameless = [(None, *r[1:]) for r in rows[2:]]
    assert R.discover_columns(spark.createDataFrame(nameless, schema), search_rows=40).count() == 1


# --- plans -------------------------------------------------------------------------------


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobin"))


@pytest.mark.parametrize(("query", "limit"), [("score_job", 14), ("postprocess", 5), ("metrics_by_group", 12), ("base_annual", 3)])
def test_plans_stay_within_their_shuffles(spark, query, limit):
    from queries import catalog

    assert shuffles(catalog.REGISTRY[query].run(spark, "/root/testdata/sf0.001")) <= limit

"""Serving records reach a keyed store once each, whatever fails on the way."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest

from riskspark.sinks import serving

ROOT = Path(__file__).resolve().parents[1]


def records(spark, n=200):
    return spark.range(n).selectExpr("id AS entity_id", "CASE WHEN id % 3 = 0 THEN 'PB' ELSE 'CE' END AS state", "id * 0.5 AS score")


def held(folder):
    rows = [json.loads(f.read_text()) for f in folder.glob("*.json") if not f.name.startswith("_")]
    return sorted((r["entity_id"], r["state"], float(r["score"])) for r in rows)


def expected(n=200):
    return [(i, "PB" if i % 3 == 0 else "CE", i * 0.5) for i in range(n)]


def last_run(folder):
    return json.loads((folder / "_last_run.json").read_text())


def test_records_arrive_in_bounded_batches_and_again_without_change(spark, tmp_path):
    options = {"path": str(tmp_path / "s"), "calls": str(tmp_path / "calls"), "victim": "-1", "failures": "0"}
    for run in (1, 2):
        serving.send_records(records(spark), "tests.flaky_store:FlakyStore", options, batch=30, senders=3)
        assert held(tmp_path / "s") == expected()
        sent = [json.loads(f.read_text()) for f in (tmp_path / "calls").glob("sent-*")]
        assert max(map(len, sent)) <= 30 and sum(map(len, sent)) == 200 * run
        assert last_run(tmp_path / "s")["records"] == 200 and last_run(tmp_path / "s")["complete"]
    serving.send_records(records(spark).selectExpr("entity_id", "state", "score + 1 AS score"), "tests.flaky_store:FlakyStore", options)
    assert held(tmp_path / "s") == [(i, s, x + 1) for i, s, x in expected()]


def test_a_batch_that_fails_is_sent_again(spark, tmp_path):
    options = {"path": str(tmp_path / "s"), "calls": str(tmp_path / "calls"), "victim": "77", "failures": "2"}
    serving.send_records(records(spark), "tests.flaky_store:FlakyStore", options, attempts=3, pause=0.01)
    assert held(tmp_path / "s") == expected() and last_run(tmp_path / "s")["complete"]


def test_a_store_that_stays_away_fails_the_write_and_a_later_one_completes_it(spark, tmp_path):
    options = {"path": str(tmp_path / "s"), "calls": str(tmp_path / "calls"), "victim": "77", "failures": "2"}
    with pytest.raises(Exception, match="store is away"):
        serving.send_records(records(spark), "tests.flaky_store:FlakyStore", options, attempts=2, pause=0.01)
    assert not last_run(tmp_path / "s")["complete"]
    serving.send_records(records(spark), "tests.flaky_store:FlakyStore", options, attempts=1)
    assert held(tmp_path / "s") == expected() and last_run(tmp_path / "s")["complete"]


def test_blank_and_repeated_keys_send_nothing(spark, tmp_path):
    frame = records(spark, 10)
    options = {"path": str(tmp_path / "s")}
    with pytest.raises(ValueError, match="repeated_key=10"):
        serving.send_records(frame.unionByName(frame), "riskspark.sinks.serving:FolderStore", options)
    with pytest.raises(ValueError, match="blank_entity_id=1"):
        blank = frame.selectExpr("CASE WHEN entity_id <> 4 THEN entity_id END AS entity_id", "state", "score")
        serving.send_records(blank, "riskspark.sinks.serving:FolderStore", options)
    assert not (tmp_path / "s").exists()
    serving.send_records(frame.limit(0), "riskspark.sinks.serving:FolderStore", options)
    assert last_run(tmp_path / "s")["records"] == 0


LOG = "riskspark.sinks.serving:LogStore"
LAYOUT = "entity_id bigint, state string, score double"


def logged(spark, folder):
    return sorted(tuple(r) for r in serving.read_log(spark, str(folder), LAYOUT).collect())


def test_a_log_store_holds_every_key_once_in_few_files(spark, tmp_path):
    options = {"path": str(tmp_path / "s")}
    newer = records(spark).selectExpr("entity_id", "state", "double(score) AS score")
    older = newer.selectExpr("entity_id", "state", "score - 1 AS score")
    for rows in (older, newer, newer):
        serving.send_records(rows, LOG, options, senders=3)
    assert logged(spark, tmp_path / "s") == expected()
    assert len(list((tmp_path / "s").iterdir())) <= 3 * 3 + 1  # a file per sender, not per record
    assert last_run(tmp_path / "s") == {"complete": True, "records": 200, "batches": last_run(tmp_path / "s")["batches"]}


def test_a_log_store_takes_a_batch_whole_or_not_at_all(spark, tmp_path):
    row = {"entity_id": 1, "state": "PB", "score": 1.0}
    store = serving.LogStore({"path": str(tmp_path)})
    store.send([row, {**row, "entity_id": 2, "state": "a\rb\u2028 é"}])
    whole = store.segment.read_bytes()
    store.send([{**row, "score": 2.0}, {**row, "entity_id": 3}])
    store.segment.write_bytes(store.segment.read_bytes()[:-9])  # the writer died
    assert logged(spark, tmp_path) == [(1, "PB", 1.0), (2, "a\rb\u2028 é", 1.0)]
    store.send([{**row, "score": 3.0}])
    assert logged(spark, tmp_path) == [(1, "PB", 3.0), (2, "a\rb\u2028 é", 1.0)]
    again = serving.LogStore({"path": str(tmp_path)})
    again.send([{**row, "score": None}])
    assert logged(spark, tmp_path)[0] == (1, "PB", None) and store.segment.read_bytes().startswith(whole)


RETRIED = """
import sys
from riskspark.session import build
from riskspark.sinks import serving
spark = build("local[2,4]", "retried", shuffle_partitions=2)
rows = spark.range(200).selectExpr("id AS entity_id", "CASE WHEN id % 3 = 0 THEN 'PB' ELSE 'CE' END AS state", "id * 0.5 AS score")
options = {"path": sys.argv[1], "calls": sys.argv[2], "victim": "77", "failures": "2"}
serving.send_records(rows, "tests.flaky_store:FlakyStore", options, attempts=1)
"""


def test_a_task_that_fails_is_retried_by_spark(tmp_path):
    folder, calls = tmp_path / "s", tmp_path / "calls"
    command = [sys.executable, "-c", RETRIED, str(folder), str(calls)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=180, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(list(calls.glob("failed-*"))) == 2
    assert held(folder) == expected() and last_run(folder)["records"] == 200

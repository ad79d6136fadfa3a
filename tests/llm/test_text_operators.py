"""Quality, personal data, exact copies, URLs: odd cases and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.llm import exact_dedup, pii, quality, queries, url_filter
from riskspark.llm.common import fold_of

from .helpers import docs, odd_texts, sentence

FOLDER = "/root/testdata/sf0.001"


def labelled(spark, n=240):
    rows, marks = [], []
    for i in range(n):
        text = sentence(i, 60 + i % 50)
        good = i % 3 > 0
        rows.append((i, text if good else re.sub(r"(\S+)", r"\1%%% !!", text).upper()))
        marks.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame([*marks, (None, 1, None), (5, None, 1), (9, 7, 7)], "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_rows(spark):
    frame, labels = labelled(spark)
    model = quality.fit(frame, labels.filter(fold_of("doc_id", 3) != 1), dictionary_pieces=200)
    rows = quality.score(frame, model).select("doc_id", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95


def test_quality_of_odd_texts_depends_on_the_text_alone(spark):
    frame, labels = labelled(spark)
    model = quality.fit(frame, labels, dictionary_pieces=200)
    rows = quality.score(docs(spark), model).select("doc_id", "text", "score").collect()
    assert len(rows) == len(odd_texts())
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1
        assert by_text.setdefault(r.text or "", r.score) == r.score


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, None)]])
def test_quality_without_two_classes(spark, marks):
    model = quality.fit(docs(spark), spark.createDataFrame(marks, "doc_id long, quality int"))
    assert quality.score(docs(spark), model).select("score").distinct().count() == 1
    assert quality.score(docs(spark, []), model).count() == 0


# --- personal data -----------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (988) 555-2485", "+", "12", ".", " ", "-", "é", "a", "00255.0.0.1", "@a.b", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        mine = [(k, *s) for k, spans in pii.base_spans(text).items() for s in spans]
        assert mine == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "9" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_segments_equal_exhaustive_search(spark):
    weights = pii.train(["call +1 (988) 555-2485 now", "ip 42.144.35.254 is", "mail a.b@c.example.com or", "pay 4111111111111111 to", "in 1999 or 12345"] * 4)
    region = pii.Region("call tel (988) 555-2485 now")
    found = pii.viterbi(region, weights)

    def best(at):
        if at == len(region.tokens):
            return 0.0
        top = best(at + 1)
        for last, candidates in enumerate(region.ending):
            for first, _, features in candidates:
                if first == at:
                    top = max(top, sum(weights.get(f, 0.0) for f in features) + best(last + 1))
        return top

    value = 0.0
    for start, end, kind in found:
        for last, candidates in enumerate(region.ending):
            for first, k, features in candidates:
                if (region.tokens[first][0], region.tokens[last][1], k) == (start, end, kind):
                    value += sum(weights.get(f, 0.0) for f in features)
    assert value == pytest.approx(best(0))


def test_personal_data_of_odd_texts(spark):
    rows = [*odd_texts(), (301, "mail bob.42@mail8.example.com, ip 10.0.0.1; tel +1 (988) 555-2485 card 4111 1111 1111 1111"), (302, "bob at mail dot example dot com")]
    frame = docs(spark, rows)
    out = pii.find(frame, pii.fit(frame)).collect()
    assert len(out) == len(rows)
    row = next(r for r in out if r.doc_id == 301)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    plain = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(rows[-2][1]))
    assert row.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert set(plain.split(",")) <= set(row.spans.split(","))
    empty = [r for r in out if r.doc_id in (4, 5, 6)]
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    assert pii.find(docs(spark, []), {}).count() == 0
    assert pii.fit(docs(spark, [])) == {}
    scattered = docs(spark, [(i, "no trigger here" if i % 5 else "call +1 (988) 555-2485 now") for i in range(20)]).repartition(20)
    assert pii.fit(scattered)  # most partitions have no region at all


def test_ids_beyond_doubles_stay_as_they_are(spark):
    large = [(1 << 60) + 1, (1 << 60) + 3, (1 << 53) + 1, None, -(1 << 62) - 1]
    frame = docs(spark, [(i, f"mail a{k}@b.com" if k else "none") for k, i in enumerate(large)]).coalesce(1)
    weights = pii.fit(frame)
    assert [r.doc_id for r in pii.find(frame, weights).collect()] == large
    model = quality.fit(frame, frame.select("doc_id", F.lit(1).alias("quality")))
    assert [r.doc_id for r in quality.score(frame, model).collect()] == large
    assert {r.doc_id for r in exact_dedup.exact_groups(frame).collect()} == set(large)


def test_spoken_addresses_and_long_hosts_are_found(spark):
    spoken = [
        "bob at mail dot example dot com",
        "ann (at) department-of-statistics.example.com",
        "ann [AT] statistics [dot] example [dot] com",
        "Ann.Lee At Mail Dot Example Dot Com",
    ]
    far = f"{sentence(77, 60)} {spoken[0]} {sentence(78, 60)}"
    rows = [(i, t) for i, t in enumerate(spoken)] + [(302, spoken[0]), (303, far), (304, "we met at noon. then we left")]
    rows += [(1000 + i, f"{sentence(i, 8)} {sentence(i, 1)}.x@{sentence(i + 500, 1)[:2]}box{'-y' * (i % 3)}.example.com {sentence(i + 900, 8)}") for i in range(60)]
    rows += [(2000 + i, f"{sentence(i, 9)} on day {i} at {sentence(i + 40, 9)}") for i in range(60)]
    frame = docs(spark, rows)
    out = {r.doc_id: r.spans for r in pii.find(frame, pii.fit(frame)).collect()}
    for i, text in enumerate(spoken):
        assert out[i] == f"email:0:{len(text)}", text
    assert out[302] == f"email:0:{len(spoken[0])}"
    at = far.index("bob")
    assert out[303] == f"email:{at}:{at + len(spoken[0])}"
    assert out[304] == ""


def test_regions_hold_every_segment_of_a_trigger():
    rng = random.Random(3)
    pieces = ["a", "at", " ", "dot", ".", "(at)", "[AT]", "@", "b-c", "1234", "x" * 30, " lorem" * 30, "\n", "éat"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))

        def candidates(low, high, text=text):
            region = pii.Region(text[low:high])
            return {
                (low + region.tokens[c[0]][0], low + region.tokens[last][1], c[1], c[2])
                for last, cs in enumerate(region.ending)
                for c in cs
                if "email:dots=0" not in c[2]
            }

        cut = set().union(*(candidates(*r) for r in pii.regions(text)), set())
        assert cut == candidates(0, len(text)), text


# --- exact copies ------------------------------------------------------------------------


def test_exact_groups(spark):
    rows = odd_texts()
    out = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs(spark), digest_all=True).collect()}
    assert len(out) == len({(i, t or "") for i, t in rows})
    for doc_id, text in rows:
        same = [i for i, t in rows if (t or "") == (text or "")]
        row = out[doc_id, hashlib.sha256((text or "").encode()).hexdigest()]
        known = [i for i in same if i is not None]
        assert row.group_size == len(same)
        assert row.keep_id == (max(known) if known else None)
        assert row.kept == (doc_id == row.keep_id)


def test_only_shared_lengths_and_prefixes_go_on(spark):
    long = "x" * 300
    rows = [(1, "alone"), (2, "pair one"), (3, "pair two"), (4, long + "a"), (5, long + "b"), (6, long + "a"), (7, None), (8, "")]
    lengths, _ = exact_dedup.shared_lengths(docs(spark, rows))
    assert {r[0] for r in lengths.collect()} == {0, 8, 301}
    keys, _ = exact_dedup.shared_keys(docs(spark, rows))
    assert sorted(r[0] for r in keys.collect()) == [0, 301]
    # prefixes are hashed above the join that leaves rows of a shared length
    plan = exact_dedup._hashed(exact_dedup._measured(docs(spark, rows), "text").join(F.broadcast(lengths), "_xd_length", "left_semi"), "text")
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, line in enumerate(lines) if "xxhash64" in line) < next(i for i, line in enumerate(lines) if "LeftSemi" in line)


def test_groups_equal_the_sql_for_repeated_rows(spark):
    rows = [(1, "same"), (1, "same"), (2, "same"), (1, "other"), (None, "none"), (None, "none"), (3, None), (4, ""), (4, "")]
    frame = docs(spark, rows)
    out = exact_dedup.exact_groups(frame, digest_all=True)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    plain = con.execute(queries.ORACLES["op3_exact_dedup"]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(plain, key=repr)


def test_wide_path_gives_the_same_groups(spark, monkeypatch):
    narrow = sorted(map(tuple, exact_dedup.exact_groups(docs(spark), digest_all=True).collect()), key=repr)
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs(spark), digest_all=True).collect()), key=repr) == narrow


def test_drop_copies_keeps_one_row_of_each_text_with_all_columns(spark):
    frame = docs(spark)
    out = exact_dedup.drop_copies(frame)
    assert out.columns == frame.columns
    assert sorted((t or "") for (t,) in out.select("text").collect()) == sorted({t or "" for _, t in odd_texts()})
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


# --- URLs --------------------------------------------------------------------------------


def test_url_rules_and_terms(spark):
    urls = [
        ("http://EN.Example.com/en/1", "en.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1?x=/es/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.com/casino", "a.com", "/casino", "com/", "allow"),
        ("http://a.com?casino", "a.com", "", None, "block"),
        ("http://acom/", "acom", "/", None, "allow"),
        ("http://x.net/es/#p", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net/es#p", "x.net", "/es", None, "allow"),
        ("http://x.org/casinos/free-bonuses", "x.org", "/casinos/free-bonuses", None, "allow"),
        ("http://x.org/free/bonus", "x.org", "/free/bonus", None, "block"),
        ("http://x.org/free/free", "x.org", "/free/free", None, "allow"),
        ("no scheme CASINO", "", "", None, "block"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
        ("http://x.org/" + "a" * 100_000, "x.org", "/" + "a" * 100_000, None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u[0], "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = {r.page_id: r for r in url_filter.judge(frame, queries.URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), urls[i][0][:60]
    assert url_filter.judge(frame.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge(frame, [], (), ()).filter("verdict <> 'allow'").count() == 0


def test_term_counts_equal_a_plain_search():
    found = url_filter.automaton(url_filter.STRICT, url_filter.SOFT)
    rng = random.Random(3)
    pieces = [*url_filter.STRICT, *url_filter.SOFT, "-", "/", ".", "a", "1", "é"]
    for _ in range(2000):
        url = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))

        def hits(term, url=url):
            return len(re.findall(rf"(?<![a-zA-Z0-9])(?={re.escape(term)}(?![a-zA-Z0-9]))", url))

        expected = sum(hits(t) for t in url_filter.STRICT), sum(hits(t) > 0 for t in url_filter.SOFT)
        assert url_filter.count_hits(found, url) == expected, url

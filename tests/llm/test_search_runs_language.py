"""Ranked search, periodic runs and language identification against plain re-statements."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import language, periodic_runs, queries, ranked_search
from . import helpers as H

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LARGE = (1 << 60) + 1
SF = "/root/testdata/sf0.01"


def folder_of(tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- ranked search -----------------------------------------------------------------------


def terms_of(text):
    return TERM.findall((text or "").translate(H._LOWER))


def ranked(docs, items, top=50):
    """Every item's best documents, by the formula."""
    bags = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs = sum(1 for _, bag in bags if bag)
    n_terms = sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms_of(text))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for doc_id, bag in bags:
            score = 0
            for term in terms & set(bag):
                m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * ((1_000_000_000 * bag[term]) // (1000 * bag[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows, key=str)


def odd_items():
    base = H.sentence(1, 120)
    rows = [(1, base[:200]), (2, base[100:400]), (3, None), (4, ""), (5, "nowhere-to-be-found"), (6, "ONE two"), (6, "three"),
            (None, "one four"), (None, "five x1"), (7, H.sentence(2, 3000)), (8, base[:200]), (LARGE, "kata lovon né")]
    return rows + [(20 + i, H.sentence(1000 + i, 30)) for i in range(20)]


def odd_docs():
    return [*H.odd_texts(), (LARGE, "kata lovon katan"), (LARGE + 2, "kata lovon katan"), (8, "One two"), (400, "x1 x1"), (401, "nées né")]


def found_rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_is_the_full_ranking(spark):
    items = spark.createDataFrame(odd_items(), "item_id long, text string")
    rows = odd_docs()
    got = found_rows(ranked_search.search(H.docs(spark, rows), items))
    assert got == ranked(rows, odd_items())
    assert len({(r[0], r[1]) for r in got}) == len(got)


def test_search_does_not_depend_on_blocks_and_parts(spark, monkeypatch):
    items = spark.createDataFrame(odd_items(), "item_id long, text string")
    rows = odd_docs()
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 100)
    monkeypatch.setattr(ranked_search, "PART_TERMS", 500)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 7)
    got = found_rows(ranked_search.search(H.docs(spark, rows).repartition(5), items, top=9))
    assert got == ranked(rows, odd_items(), top=9)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(odd_items(), "item_id long, text string")
    none = items.limit(0)
    assert ranked_search.search(H.docs(spark, []), items).count() == 0
    assert ranked_search.search(H.docs(spark), none).count() == 0
    assert ranked_search.search(H.docs(spark, [(1, None), (2, "...")]), items).count() == 0


def test_many_equal_scores_keep_the_smallest_ids(spark):
    rows = [(i, "kata lovo") for i in range(300, 0, -1)] + [(1000 + i, f"filler{i}") for i in range(600)]
    items = spark.createDataFrame([(1, "kata")], "item_id long, text string")
    got = ranked_search.search(H.docs(spark, rows).repartition(7), items).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 51))


def expand(node, children, terms):
    if node < terms:
        return [node]
    return [t for child in children[node - terms] for t in expand(child, children, terms)]


def test_sharing_graph_keeps_every_item_and_shares(spark):
    rng = np.random.default_rng(5)
    common = rng.choice(60, 25, replace=False)
    lists = [np.unique(np.concatenate([common, rng.integers(0, 300, 12)])) for _ in range(30)]
    lists += [np.array([7]), np.arange(5), np.arange(5)]
    children, rounds, roots = ranked_search.share(lists, 300)
    for wanted, left in zip(lists, roots, strict=True):
        assert sorted(t for node in left for t in expand(node, children, 300)) == sorted(wanted)
    assert rounds[-1] == 300 + len(children)
    plain = sum(len(x) - 1 for x in lists)
    assert len(children) + sum(len(r) - 1 for r in roots) < 0.6 * plain
    starts = np.concatenate([[300], rounds[:-1]])
    for start, end in zip(starts, rounds, strict=True):
        assert children[start - 300 : end - 300].max() < start  # a round joins older nodes only


# --- periodic runs -----------------------------------------------------------------------


def all_runs(words):
    """Every run, from the stretches of every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or words[i] != words[i - q]:
                if i - start >= max(6, 4 * q) and (start, i) not in found:
                    found[start, i] = q
                start = i - q + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, letters, longest=40):
    parts = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, longest))]
        parts += (unit * rng.randint(1, 7))[: rng.randint(1, 400)] + [rng.choice(letters) for _ in range(rng.randint(0, 9))]
    return parts


def test_runs_equal_the_plain_search():
    rng = random.Random(3)
    texts = [periodic(rng, letters) for letters in ("ab", "abc", "abcdefghij") for _ in range(120)]
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], list("abcab")]
    codes = {c: int(x) for c, x in zip("abcdefghij", np.random.default_rng(1).integers(1, 1 << 62, 10), strict=True)}
    arrays = [np.array([codes[w] for w in t], np.uint64) for t in texts]
    assert periodic_runs.find_runs(arrays) == [all_runs(t) for t in texts]
    for t, a in list(zip(texts, arrays, strict=True))[:40]:  # one by one, without neighbours
        assert periodic_runs.find_runs([a]) == [all_runs(t)]


def test_runs_of_long_periods_are_found():
    rng = np.random.default_rng(2)
    for period in (9, 14, 15, 22, 23, 37, 38, 100, 1000, 2500):
        unit = rng.integers(1, 1 << 62, period).astype(np.uint64)
        noise = rng.integers(1, 1 << 62, 2 * period).astype(np.uint64)
        text = np.concatenate([noise[:period], np.tile(unit, 5)[: 4 * period], noise[period:]])
        assert periodic_runs.find_runs([text]) == [[(period, 4 * period, period)]]
        short = np.concatenate([noise[:period], np.tile(unit, 5)[: 4 * period - 1], noise[period:]])
        assert periodic_runs.find_runs([short]) == [[]]


def runs_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words) if n < 3000 else None
    if runs is None:
        return None
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def run_rows():
    rng = random.Random(8)
    rows = [r for r in H.odd_texts() if r[0] != 9]
    rows += [(1000 + i, "\t ".join(periodic(rng, ["da", "DA", "é", "x y"]))) for i in range(150)]
    seeded = [i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows += [(i, H.sentence(i, 5 + i % 300)) for i in seeded] + [(seeded[0], None), (seeded[1], " ")]
    return [*rows, (LARGE, "a " * 7), (LARGE + 2, "b " * 8), (None, "c " * 9)]


def test_run_query_equals_the_plain_statement(spark, tmp_path):
    rows = run_rows()
    folder = folder_of(tmp_path, documents=H.docs(spark, rows))
    got = queries.op12_periodic_runs(spark, folder)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(runs_digest(*r)) for r in rows)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.with_runs(H.docs(spark, [])).count() == 0


# --- language ----------------------------------------------------------------------------


def cuts(marked):
    for n in range(len(marked)):
        for at in itertools.combinations(range(1, len(marked)), n):
            yield [marked[a:b] for a, b in itertools.pairwise((0, *at, len(marked)))]


@pytest.fixture
def lattice():
    pieces = (language.START, language.START + "a", "a", "ab", "b", "bab", "ba", "né")
    p = np.random.default_rng(4).random((len(pieces) + 1, 3))
    return language.Lattice(pieces, p / p.sum(axis=0))


def piece_numbers(lattice, cut):
    numbers = [lattice.number.get(piece, lattice.unknown if len(piece) == 1 else None) for piece in cut]
    return None if None in numbers else numbers


def test_forward_sums_all_cuts(lattice):
    for word in ("a", "abab", "babn", "nénéa", "xaby"):
        total = np.zeros(3)
        uses = defaultdict(float)
        for cut in cuts(language.START + word):
            numbers = piece_numbers(lattice, cut)
            if numbers is not None:
                value = np.prod(lattice.probabilities[numbers], axis=0)
                total += value
                for k in numbers:
                    uses[k, 1] += value[1]
        assert lattice.forward(word) == pytest.approx(np.log(total))
        found, many = np.zeros_like(lattice.probabilities), np.zeros_like(lattice.probabilities)
        lattice.expected(word, 1, 2.0, found)
        lattice.expected_all([word, "ab", word], np.array([1, 0, 1]), np.array([1, 5, 1]), many)
        wanted = np.zeros_like(found)
        for k, value in uses.items():
            wanted[k] = 2 * value / total[1]
        assert found == pytest.approx(wanted)
        assert many[:, 1] == pytest.approx(wanted[:, 1])


def test_many_words_at_once_score_as_one_by_one(lattice):
    rng = random.Random(1)
    found = ["".join(rng.choice("abnéxζ") for _ in range(rng.randint(1, language.SHORT_WORD))) for _ in range(500)]
    assert lattice.forward_all(found) == pytest.approx(np.stack([lattice.forward(w) for w in found]))
    assert lattice.forward_all(["a"]) == pytest.approx(lattice.forward("a")[None])


def test_a_small_memory_changes_no_score(lattice, monkeypatch):
    pieces = tuple(lattice.number)
    model = language.Model(("xa", "xb", "xc"), pieces, lattice.probabilities, np.log([0.2, 0.3, 0.5]))
    rng = random.Random(2)
    texts = ["", "1 2", *(" ".join("".join(rng.choices("abné", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    expected, counts = language.Scorer(model).log_probabilities(texts)
    for text, row, n in zip(texts, expected, counts, strict=True):
        words = language.words_of(text)
        assert n == len(words)
        assert row == pytest.approx(model.prior + sum((lattice.forward(w) for w in words), np.zeros(3)))
    monkeypatch.setattr(language, "CACHE_CELLS", 60)
    scorer = language.Scorer(model)
    assert np.concatenate([scorer.log_probabilities([t])[0] for t in texts]) == pytest.approx(expected)


def test_very_long_words_stay_in_range(lattice):
    once, long = lattice.forward("ab" * 20), lattice.forward("ab" * 40_000)
    assert np.isfinite(long).all()
    more = lattice.forward("ab" * 40)
    assert long == pytest.approx(once + (more - once) / 20 * (40_000 - 20), rel=1e-6)
    found = np.zeros_like(lattice.probabilities)
    lattice.expected("ab" * 2000, 0, 1.0, found)
    assert found.sum() > 1000


def test_held_out_languages_are_told_apart(spark):
    got = queries.op13_language_id(spark, SF).toPandas()
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(want, on="doc_id")
    assert len(both) == len(want)
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_odd_texts_and_rows(spark):
    train = [(i, H.sentence(i, 30), "xa") for i in range(20)] + [(50 + i, "the cat sat on a mat " * 3, "xb") for i in range(20)]
    train += [(None, "the the", "xb"), (90, None, "xa"), (91, "the mat", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ("xa", "xb")
    rows = [(LARGE, "the mat"), (LARGE + 2, "KATA lovon MI"), (None, "the cat"), (1, None), (2, ""), (3, "12 — ½ _ ²"),
            (4, "The Mat"), (4, "The Mat"), (5, "ζ"), (6, "x" * 50_000)]
    got = language.identify(H.docs(spark, rows), model).select("doc_id", "lang_pred", "score", "rate").collect()
    found = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert found[:8] == [(LARGE, "xb"), (LARGE + 2, "xa"), (None, "xb"), (1, "und"), (2, "und"), (3, "und"), (4, "xb"), (4, "xb")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert found[8][1] in model.languages


def test_nothing_to_learn_from(spark):
    empty = H.docs(spark, []).withColumn("lang", F.lit(None).cast("string"))
    model = language.fit(empty)
    assert [(r["lang_pred"], r["score"]) for r in language.identify(H.docs(spark, [(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert language.identify(empty, model).count() == 0

"""Near duplicates, language model, decontamination, mixing, pipeline: brute force on small tables."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskspark.llm import decontaminate, lm_score, mixing, near_dup, words
from riskspark.llm.common import fold_of
from riskspark.llm.components import components
from riskspark.llm.elias_fano import EliasFano, MappedArrays, Trie

from .helpers import Union, docs, edited, odd_texts, sentence
from .helpers import words as split

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text, size):
    found = split(text)
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))) if found else frozenset()


def plain_components(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    joined = Union()
    for i, a in sets:
        joined.find(i)
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                joined.join(i, j)
    return {i: joined.find(i) for i, _ in sets}


def family_rows():
    rows = [(i, t) for i, t in odd_texts()]
    for f in range(6):
        base = sentence(50 + f, 90)
        rows += [(1000 + 100 * f + k, edited(base, k, k % 6)) for k in range(40)]
    return rows


@pytest.mark.parametrize(("size", "node"), [(4, 2048), (5, 2048), (4, 8)])
def test_near_groups_equal_brute_force(spark, monkeypatch, size, node):
    monkeypatch.setattr(near_dup, "NODE", node)  # a tiny limit forces branching and blocks
    rows = family_rows()
    out = near_dup.near_groups(docs(spark, rows), size=size).collect()
    expected = plain_components(rows, size, 80)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id], r.doc_id
            assert r.kept == (r.doc_id == r.component_id)
    sizes = Counter((r.doc_id, r.n_shingles) for r in out if r.doc_id is not None)
    assert sizes == Counter((i, len(shingle_set(t, size))) for i, t in rows if i is not None)


def test_near_groups_of_an_empty_table(spark):
    assert near_dup.near_groups(docs(spark, [])).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300, 360)] + [(0, i) for i in range(1, 50)] + [(5, 5), (None, 3), (9, 8)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 300 for i in range(300, 361)}, **{i: 0 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_word_rule():
    texts = [t for _, t in odd_texts()] + ["a", "a", "b a", "\x1ca b", "\x85 x"]
    hashes, at = words.word_hashes(words.pa.array(texts, words.pa.string()))
    seen = {}
    for i, text in enumerate(texts):
        found = split(text)
        assert at[i + 1] - at[i] == len(found)
        for word, h in zip(found, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# --- language model ----------------------------------------------------------------------


def plain_scores(rows):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in rows]
    tokens = [[*split(t), None] for _, t in rows]
    single, pair = Counter(), Counter()
    for out, found in zip(held, tokens, strict=True):
        if not out:
            single.update(found)
            pair.update(zip([None, *found], found, strict=False))
    n, v = sum(single.values()), len(single)
    result = []
    for out, found in zip(held, tokens, strict=True):
        base = score = 0.0
        for w, x in zip([None, *found], found, strict=False):
            p = (single[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10((pair[w, x] + lm_score.STRENGTH * p) / (single[w] + lm_score.STRENGTH))
        result.append((out, len(found), sum(single[x] > 0 for x in found), n, base, score))
    return result


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_the_formula(spark, monkeypatch, small):
    if small:  # many blocks, many shards, split contexts
        for name, value in (("BLOCK_BYTES", 2000), ("SHARD_WORDS", 50), ("SHARD_PAIRS", 300)):
            monkeypatch.setattr(lm_score, name, value)
    rows = [(i if i is not None else None, t) for i, t in odd_texts()]
    out = lm_score.score(docs(spark, rows), fold_of("doc_id", 5) == 1).collect()
    expected = plain_scores(rows)
    assert len(out) == len(rows)
    key = lambda i, e: (i is not None, i or 0, e[1], round(e[4], 3))
    mine = sorted(((r.doc_id, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in out), key=lambda x: key(*x))
    plain = sorted(zip([i for i, _ in rows], expected, strict=True), key=lambda x: key(*x))
    for (i, a), (j, b) in zip(mine, plain, strict=True):
        assert i == j and a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], abs=1e-3 * b[1] + 1e-6 * abs(b[5]))


def test_a_pair_that_is_everywhere_does_not_fill_a_shard(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 10_000), ("SHARD_PAIRS", 1000)):
        monkeypatch.setattr(lm_score, name, value)
    rows = [(i, f"{'junk ' * 60}{sentence(i, 20)}") for i in range(300)]
    run, unpack = lm_score._pair_codes, lm_score.unpack_pairs

    def bounded(table):
        held = [unpack(p.as_buffer().to_pybytes()) for p in table["payload"] if p.is_valid]
        assert sum(len(h[0]) for h in held) <= 3000
        return run(table)

    monkeypatch.setattr(lm_score, "_pair_codes", bounded)
    out = lm_score.score(docs(spark, rows), fold_of("doc_id", 5) == 1).collect()
    plain = {i: e for (i, _), e in zip(rows, plain_scores(rows), strict=True)}
    assert len(out) == len(rows)
    for r in out:
        assert r.score == pytest.approx(plain[r.doc_id][5], abs=1e-3 * r.n_tokens)


def test_packed_pairs_come_back():
    rng = np.random.default_rng(8)
    for size, words in ((1, 5), (500, 40), (90_000, 1 << 20)):
        keys = np.unique(rng.integers(0, words, (size, 2)), axis=0)
        count = rng.integers(1, 1 << 40, words)
        code = rng.integers(0, 1 << 16, words).astype(np.uint16)
        context, successor = keys[:, 0] << 20, keys[:, 1] << 20
        training = rng.integers(0, 3, len(keys)).astype(np.uint32)
        sent = context, count[keys[:, 0]], successor, code[keys[:, 1]], training
        for a, b in zip(sent, lm_score.unpack_pairs(lm_score.pack_pairs(*sent)), strict=True):
            assert (a == b).all()


def test_model_sums_to_one():
    rows = [(2, "a b a b c"), (3, "a c"), (4, "b")]
    tokens = [[*split(t), None] for _, t in rows]
    single = Counter(x for f in tokens for x in f)
    pair = Counter(p for f in tokens for p in zip([None, *f], f, strict=False))
    n, v, m = sum(single.values()), len(single), lm_score.STRENGTH
    for w in single:
        total = sum((pair[w, x] + m * (single[x] + 0.5) / (n + 0.5 * (v + 1))) / (single[w] + m) for x in single)
        unknown = m * 0.5 / (n + 0.5 * (v + 1)) / (single[w] + m)
        assert total + unknown == pytest.approx(1)


def test_scores_of_an_empty_table(spark):
    assert lm_score.score(docs(spark, []), F.lit(False)).count() == 0
    rows = lm_score.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)}


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (7, 3), (1000, 10), (5000, 10**12)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        store = MappedArrays()
        sequence = EliasFano(store, values)
        for a, b in ((0, n), (n // 2, n), (n // 3, n // 2 + 1), (n - 1, n)):
            assert (sequence.slice(a, b) == values[a:b]).all()
        unique = np.unique(values)
        found = EliasFano(store, unique).find(np.unique(np.concatenate([unique, unique + np.uint64(1)])))
        assert (found >= 0).sum() == len(unique)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (20000, 2))})
    context, successor = (np.array(x) for x in zip(*pairs, strict=True))
    keep = rng.random(len(pairs)) < 0.5
    codes = rng.integers(0, 60000, keep.sum())
    trie = Trie(context[keep], successor[keep], codes, 300)
    assert (trie.lookup(context, successor)[keep] == codes).all()
    assert (trie.lookup(context, successor)[~keep] == -1).all()
    trie.close()


# --- decontamination ---------------------------------------------------------------------


def plain_matches(rows, items, size=5):
    import re

    def tokens(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())

    def grams(w):
        return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()

    cut = {i: tokens(t) for i, t in items}
    frequency = Counter(g for w in cut.values() for g in grams(w))
    weight = lambda g: 1 / frequency[g] if g in frequency else 1.0
    out = {}
    for doc, text in rows:
        own = tokens(text)
        for item, w in cut.items():
            if not w or not own:
                continue
            a, length = grams(w), min(len(w), len(own))
            for start in range(len(own) - length + 1):
                b = grams(own[start : start + length])
                top = sum(weight(g) * min(a[g], b[g]) for g in a)
                value = top / sum(weight(g) * max(a[g], b[g]) for g in {*a, *b})
                if value >= 0.8 - 1e-12 and value > out.get((doc, item), (0, 0))[0] + 1e-12:
                    out[doc, item] = (value, start)
    return out


def test_matches_equal_brute_force(spark, monkeypatch):
    items = [(1, sentence(900, 40)), (2, sentence(901, 15)), (3, sentence(900, 40) + " more words"), (4, None), (5, ""), (6, "Two short"), (7, "one two three four five"), (8, sentence(902, 59)), (None, sentence(903, 30))]
    rows = [r for r in odd_texts() if len(r[1] or "") < 5000]
    for k in range(40):
        passage = edited(items[k % 2 * 7][1], k, k % 5)
        rows.append((700 + k, f"{sentence(k, k)} {passage.title()}, {sentence(99 + k, 3 * k)}"))
    rows += [(800, items[0][1]), (801, items[1][1][:-10]), (802, "x two SHORT, y"), (803, " ".join([items[1][1]] * 30))]
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    expected = plain_matches(rows, items)
    assert len(expected) > 20
    # in one index, in parts, and with slices of windows and comparisons that are cut everywhere
    for limit, windows, cells in ((decontaminate.INDEX_BYTES, decontaminate.WINDOWS, decontaminate.CELLS), (300, 1, 1)):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
        monkeypatch.setattr(decontaminate, "WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        out = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find(docs(spark, rows), benchmark).collect()}
        assert {k: v[1] for k, v in out.items()} == {k: v[1] for k, v in expected.items()}
        assert all(out[k][0] == pytest.approx(expected[k][0]) for k in out)
    assert decontaminate.find(docs(spark, []), benchmark).count() == 0
    assert decontaminate.find(docs(spark, rows), benchmark.limit(0)).count() == 0


def test_a_split_benchmark_gives_exactly_the_unsplit_matches(spark, monkeypatch):
    common = sentence(910, 25)
    items = [(i, f"{common} {sentence(911 + i, 25)}") for i in range(12)]
    rows = [(i, f"{sentence(i, 20)} {edited(items[i % 12][1], i, i // 12 % 2)} {sentence(50 + i, 9)}") for i in range(60)]
    benchmark = spark.createDataFrame([*items, (None, items[3][1]), (4, items[5][1])], "item_id long, text string")
    expected = plain_matches(rows, items)
    found = {}
    for limit in (decontaminate.INDEX_BYTES, 2000, 300):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
        found[limit] = sorted(map(tuple, decontaminate.find(docs(spark, rows), benchmark).collect()), key=repr)
        own = {r[:2]: r[2] for r in found[limit] if r[1] not in (None, 4)}
        assert own == pytest.approx({k: v[0] for k, v in expected.items() if k[1] != 4})
    assert found[2000] == found[300] == found[decontaminate.INDEX_BYTES]
    assert len(expected) > 30 and min(v[0] for v in expected.values()) < 0.95


def test_repeating_an_item_changes_no_match(spark):
    item = sentence(920, 54)  # 50 shingles, of which the passage holds 45
    rows = [(1, f"{sentence(921, 30)} {item.rpartition(' ')[0].rsplit(' ', 4)[0]} {sentence(922, 30)}")]
    once = spark.createDataFrame([(1, item)], "item_id long, text string")
    twice = spark.createDataFrame([(1, item), (2, item), (3, item.replace(" ", ", ") + "!")], "item_id long, text string")
    alone = decontaminate.find(docs(spark, rows), once).collect()
    assert [(r.item_id, r.similarity) for r in alone] == [(1, pytest.approx(45 / 55))]
    out = decontaminate.find(docs(spark, rows), twice).collect()
    assert sorted((r.item_id, r.similarity) for r in out) == [(i, pytest.approx(45 / 55)) for i in (1, 2, 3)]


def test_block_index_reaches_the_whole_radius():
    index = decontaminate.Index([1], [sentence(5, 30)])
    _, prints = index.groups[30]
    rng = np.random.default_rng(0)
    bits = np.unpackbits(prints[0].view(np.uint8))
    others = []
    for _ in range(500):
        flipped = bits.copy()
        flipped[rng.choice(decontaminate.BITS, index.radius, replace=False)] ^= 1
        others.append(np.packbits(flipped).view(np.uint32))
    assert decontaminate.within_blocks(np.stack(others), prints, index.radii).all()
    assert len(list(index.candidates(np.stack(others), prints))) == 500


def test_block_radii_are_tight():
    for radius in (0, 5, 7, 8, 40, 68):
        radii = decontaminate.block_radii(radius)
        assert sum(r + 1 for r in radii) == radius + 1 and min(radii) >= -1


def test_block_index_rejects_nearly_all_random_fingerprints():
    rng = np.random.default_rng(1)
    some, other = (rng.integers(0, 1 << 32, (600, decontaminate.BLOCKS), dtype=np.uint32) for _ in range(2))
    share = decontaminate.within_blocks(some, other, decontaminate.block_radii(decontaminate.RADIUS)).mean()
    assert 0.005 < share < 0.03


def test_the_index_takes_a_few_times_the_benchmark_text():
    texts = [sentence(k, 60) for k in range(3000)]
    index = decontaminate.Index(list(range(3000)), texts)
    filters = sum(a[1].nbytes for a in index.anchors.values())
    assert len(pickle.dumps(index)) - filters < 6 * sum(map(len, texts))


# --- mixing ------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows = [(i, sentence(i, 40) + (" bad" * 20 if i % 4 == 0 else " toxic" * 20 if i % 7 == 0 else "")) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "no id"), (902, sentence(7, 40)), (902, sentence(8, 40))]
    marks = [(i, 0 if i % 4 == 0 else 1, int(i % 7 == 0 and i % 4 > 0)) for i in range(0, 400, 2)] + [(1, None, None), (None, 1, 1)]
    labels = mixing.quality_domains(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    targets = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    out = mixing.mix(docs(spark, rows), labels, targets).collect()
    assert len(out) == len({i for i, _ in rows})
    total = sum(r.n_tokens for r in out)
    for name, share in targets.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in out) / total == pytest.approx(share, abs=1e-4)
    for r in out:
        assert r.rate >= 0 and abs(r.copies - r.rate) <= 1
        assert r.p_clean + r.p_low + r.p_toxic == pytest.approx(1)
    assert sum(r.n_tokens for r in out) == sum(len(split(t)) for _, t in rows)


def plain_squares(p, tokens, share, steps=30_000):
    """Smallest squared gap by an accelerated projected gradient over all documents."""
    weight = tokens / tokens.sum()
    length = 1 / np.linalg.eigvalsh((p * weight[:, None]).T @ p)[-1]
    rate = ahead = np.ones(len(p))
    for k in range(steps):
        new = np.maximum(0, ahead - length * (p @ (p.T @ (ahead * weight) - share)))
        ahead, rate = new + k / (k + 3) * (new - rate), new
    gap = p.T @ (rate * weight) - share
    return gap @ gap


@pytest.mark.parametrize("spread, targets", [(1, [0.1, 0.2, 0.7]), (5, [0.02, 0.03, 0.95]), (20, [0.9, 0.1, 0.0])])
def test_projected_steps_reach_the_least_squares_optimum(spark, spread, targets):
    rng = np.random.default_rng(4)
    p = np.round(rng.dirichlet([spread] * 3, 60), 3)
    p[:, 2] = 1 - p[:, 0] - p[:, 1]
    tokens = rng.integers(1, 200, 60)
    frame = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    rate = np.maximum(0, 1 + p @ mixing.fit_rates(frame, targets))
    gap = (p.T @ (rate * tokens)) / tokens.sum() - targets
    if spread == 1:  # can be met
        assert np.abs(gap).max() < 1e-5
    else:
        assert gap @ gap > 1e-4
    assert gap @ gap <= 1.001 * plain_squares(p, tokens, np.array(targets)) + 1e-9


def test_posteriors_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 64)
    rows = [(i, sentence(i, 30) + (" bad" * (i % 5) if i % 2 else "")) for i in range(40)] + [(50, None), (51, "word " * 40_000)]
    marks = [(i, "low" if i % 2 else "clean") for i in range(30)]
    labels = spark.createDataFrame(marks, "doc_id long, domain string")
    weights, priors = mixing.train(docs(spark, rows), labels, ["clean", "low"])
    out = {r.doc_id: r for r in mixing.posteriors(docs(spark, rows), weights, priors).collect()}
    words = sorted({w for _, t in rows for w in split(t)})
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("b"))
    bucket = dict(map(tuple, hashed.collect()))
    counts = {d: Counter(bucket[w] for i, t in rows if dict(marks).get(i) == d for w in split(t)) for d in ("clean", "low")}
    for i, text in rows:
        score = [
            math.log(16 / 32) + mixing.TEMPER * sum(math.log((counts[d][bucket[w]] + 0.1) / (sum(counts[d].values()) + 6.4)) for w in split(text))
            for d in ("clean", "low")
        ]
        assert out[i].n_tokens == len(split(text))
        assert out[i].p0 == pytest.approx(1 / (1 + math.exp(min(700, score[1] - score[0]))), abs=1.1e-3)


def test_mixing_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(docs(spark), labels, {"a": 0.5, "b": 0.5})
    assert {(r.p_a, r.p_b, r.copies) for r in out.collect()} == {(0.5, 0.5, 1)}
    assert mixing.mix(docs(spark, []), labels, {"a": 1.0}).count() == 0


# --- pipeline ----------------------------------------------------------------------------


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    good = [(i, sentence(i, 80)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w.upper()}%%%" for w in sentence(300 + i, 80).split())) for i in range(30)]
    copies = [(200 + i, good[0][1]) for i in range(5)]
    near = [(300 + i, edited(good[1][1], i, 1)) for i in range(5)]
    item = sentence(999, 40)
    leaks = [(400 + i, f"{sentence(600 + i, 30)} {item} {sentence(700 + i, 30)}") for i in range(4)]
    rows = good + bad + copies + near + leaks + [(None, sentence(55, 70)), (500, None), (500, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "mix":
            assert out.columns == frame.columns
        found[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "mix":
            path = str(tmp_path / f"stage-{name}")
            out.write.parquet(path)
            frame = spark.read.parquet(path)
    assert {i for i, _ in bad}.isdisjoint(found["quality"]) and {i for i, _ in good} <= found["quality"]
    assert found["exact"] & {0, *(i for i, _ in copies)} == {204}
    assert found["near"] & {1, *(i for i, _ in near)} == {1}
    assert {i for i, _ in leaks}.isdisjoint(found["decontaminate"])
    assert {i for i, _ in good[2:]} <= found["mix"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(found["mix"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

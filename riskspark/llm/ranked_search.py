"""Ranked search of many items at once by evaluating their common parts once.

Items (queries) share terms. Sets of terms that several items hold are mined first: each item's terms
are put in one order (most shared first), and the pair of neighbours that most items have in common
becomes a node of a sharing graph, again and again, until no pair occurs twice. A node is the sum of its
two children, a leaf is a term, and an item is the sum of its few remaining nodes. Per block of documents
every leaf's partial scores are written into an accumulator once, nodes are added up in the order in which
they were mined, and items are read off. Integer scores make any order of addition give the same result.

Documents are read once: each becomes its item terms and their frequencies, written as a small table.
A task also writes its own totals (documents per term, terms in all), which Spark sums. A second pass over
the small table scores documents against all items; each task keeps the best ``top`` per item and only
those are shuffled, first by item and part, then by item.

Bounds: items are dealt to parts of about ``PART_TERMS`` (item, term) entries, of which the vocabulary and
the graphs are broadcast, and within a part to blocks of about ``BLOCK_TERMS`` entries, whose accumulators
fit ``ACCUMULATOR_BYTES``. Neither changes a result. Terms are told apart by 64-bit hashes.

Score of a document for an item: the sum over the item's terms, once each, of
``w * ((1000000000 tf) div (1000 tf + 20 m))`` with ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and
``m = 100 - 50 + ((50 n N) div L)``; the ranking lists scores above 0, equal scores by ascending id.

Defined results: NULL and empty texts have no terms and are never listed. Rows that share a document id
are documents of their own; a NULL id comes after all others. Rows that share an item id, NULL included, are
one item with the terms of all. An empty table of either kind gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import ascii_lower, saved, whole
from riskspark.llm.words import U64, chunks, word_hashes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
PART_TERMS = 1 << 20
BLOCK_TERMS = 1 << 15
ACCUMULATOR_BYTES = 64 << 20
BLOCK_DOCS = 512
TOP_PARTS = 16
_PLAN = "block int, hashes array<bigint>, node_pairs array<int>, rounds array<int>, items array<bigint>, ends array<int>, roots array<int>"


def share(lists: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sharing graph of lists of term numbers below ``terms``.

    Returns the children of the nodes numbered from ``terms``, the node count after each round, and each
    list's remaining nodes. Within a round only older nodes are joined.
    """
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    # most shared first; terms of exactly the same items stand side by side
    uses = np.bincount(flat, minlength=terms)
    signature = np.zeros(terms, U64)
    np.bitwise_xor.at(signature, flat, (owner.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    order = np.lexsort((flat, signature[flat], -uses[flat], owner))
    flat, owner = flat[order], owner[order]
    pairs, rounds, count = [], [], terms
    while len(flat) > 1:
        same = owner[1:] == owner[:-1]
        key = flat[:-1] * count + flat[1:]
        found, inverse, times = np.unique(key[same], return_inverse=True, return_counts=True)
        if not len(times) or times.max() < 2:
            break
        # a total order of pairs, by use and then by number; pairs that occur once stand last
        place = np.empty(len(found), np.int64)
        place[np.lexsort((found, times))] = np.arange(len(found))
        strength = np.full(len(key), -1, np.int64)
        strength[same] = np.where(times[inverse] > 1, place[inverse], -1)
        left = np.concatenate([[-1], strength[:-1]])
        right = np.concatenate([strength[1:], [-1]])
        taken = np.flatnonzero((strength >= 0) & (strength > left) & (strength >= right))
        chosen, number, times = np.unique(key[taken], return_inverse=True, return_counts=True)
        useful = times > 1  # what lost all its other uses to stronger pairs waits
        fresh = np.cumsum(useful) - 1 + count
        taken, number = taken[useful[number]], number[useful[number]]
        pairs.append(np.stack([chosen[useful] // count, chosen[useful] % count], axis=1))
        flat[taken] = fresh[number]
        gone = np.zeros(len(flat), bool)
        gone[taken + 1] = True
        flat, owner = flat[~gone], owner[~gone]
        count += int(useful.sum())
        rounds.append(count)
    children = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    cuts = np.searchsorted(owner, np.arange(1, len(lists)))
    return children, np.array(rounds, np.int64), np.split(flat, cuts)


@dataclass(frozen=True)
class Block:
    """Items of one block: their terms by number in the part's vocabulary, and the sharing graph."""

    number: int
    terms: np.ndarray
    children: np.ndarray
    rounds: np.ndarray
    items: np.ndarray
    ends: np.ndarray
    roots: np.ndarray

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """(items, documents) sums from the (terms, documents) partial scores."""
        terms = len(self.terms)
        sums = np.zeros((terms + len(self.children), impacts.shape[1]), np.int64)
        sums[:terms] = impacts
        live = np.zeros(len(sums), bool)
        live[:terms] = impacts.any(axis=1)
        start = terms
        for end in self.rounds:
            pair = self.children[start - terms : end - terms]
            active = np.flatnonzero(live[pair[:, 0]] | live[pair[:, 1]])
            sums[start + active] = sums[pair[active, 0]] + sums[pair[active, 1]]
            live[start + active] = True
            start = end
        return np.add.reduceat(sums[self.roots], np.concatenate([[0], self.ends[:-1]]), axis=0)


class Best:
    """The best ``top`` documents of each item seen so far by one task."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.zeros(items, np.int64)  # a document must reach this score, and more than 0
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        self.waiting: list[tuple] = []
        self.count = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, column = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        if len(item):
            self.waiting.append((item, scores[item, column], ids[column], null[column]))
            self.count += len(item)
            if self.count > max(1 << 18, 2 * self.top * len(self.least)):
                self.merge()

    def merge(self) -> None:
        item, score, ids, null = (np.concatenate(c) for c in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        first = np.searchsorted(item, item, side="left")
        kept = np.arange(len(item)) - first < self.top
        self.held = [item[kept], score[kept], ids[kept], null[kept]]
        self.waiting, self.count = [], 0
        item, score = self.held[0], self.held[1]
        sizes = np.bincount(item, minlength=len(self.least))
        ends = np.cumsum(sizes)
        full = sizes >= self.top
        self.least[full] = score[ends[full] - 1]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Numbered items with their distinct terms, dealt to blocks; the entries are counted once."""
    terms = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(whole(text)), F.lit(TERM), F.lit(0))))
    rows = benchmark.select(F.col(item_id).alias("item_id"), terms.alias("term")).distinct()
    items = saved(rows.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "search-items")
    entries = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-entries // BLOCK_TERMS))
    parts = max(1, -(-entries // PART_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    in_block = Window.partitionBy("block").orderBy("item_id")  # a block is bounded
    numbered = items.withColumn("block", block).withColumn("item", F.row_number().over(in_block).cast("bigint"))
    return saved(numbered.withColumn("part", F.col("block") % parts), "search-numbered"), parts


def _mine(table: pa.Table) -> pa.Table:
    """The sharing graph of one block's items."""
    lists = table.column("terms").combine_chunks()
    ends = np.cumsum([len(x) for x in lists])
    flat, _ = word_hashes(lists.flatten(), alnum_only=True)
    hashes, number = np.unique(flat, return_inverse=True)
    children, rounds, roots = share(np.split(number, ends[:-1]), len(hashes))
    columns = {
        "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
        "hashes": pa.array([hashes.view(np.int64)], pa.list_(pa.int64())),
        "node_pairs": pa.array([children.ravel().astype(np.int32)], pa.list_(pa.int32())),
        "rounds": pa.array([rounds.astype(np.int32)], pa.list_(pa.int32())),
        "items": pa.array([table.column("item").to_numpy()], pa.list_(pa.int64())),
        "ends": pa.array([np.cumsum([len(r) for r in roots]).astype(np.int32)], pa.list_(pa.int32())),
        "roots": pa.array([np.concatenate(roots).astype(np.int32)], pa.list_(pa.int32())),
    }
    return pa.table(columns)


def _plan(items: DataFrame) -> tuple[np.ndarray, list[Block]]:
    """Sorted vocabulary of a part and its blocks (about ``PART_TERMS`` numbers reach the driver)."""
    mined = items.select("block", "item", "terms").groupBy("block").applyInArrow(_mine, _PLAN).toArrow()
    rows = sorted(mined.to_pylist(), key=lambda r: r["block"])
    rows = [{k: np.array(v, np.int64) if isinstance(v, list) else v for k, v in r.items()} for r in rows]
    vocabulary = np.unique(np.concatenate([r["hashes"].view(U64) for r in rows]))
    blocks = [
        Block(r["block"], np.searchsorted(vocabulary, r["hashes"].view(U64)), r["node_pairs"].reshape(-1, 2), r["rounds"],
              r["items"], r["ends"], r["roots"])
        for r in rows
    ]
    return vocabulary, blocks


def _postings(docs: DataFrame, doc_id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """Per document with item terms: id, n, terms and frequencies. Rows with n = -1 are a task's totals.

    The totals list terms with their number of documents; two numbers beyond the vocabulary stand for
    the documents that have any term and for all terms with repeats.
    """
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        totals = np.zeros(size + 2, np.int64)
        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(texts):
                hashes, first = word_hashes(texts.slice(a, b - a), alnum_only=True)
                n = np.diff(first)
                totals[size] += np.count_nonzero(n)
                totals[size + 1] += len(hashes)
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = vocabulary[at] == hashes
                owner = np.repeat(np.arange(b - a), n)[hit]
                pair, times = np.unique(owner * size + at[hit], return_counts=True)
                owner, term = pair // size, pair % size
                totals[:size] += np.bincount(term, minlength=size)
                rows = np.flatnonzero(np.bincount(owner, minlength=b - a))
                ends = np.searchsorted(owner, rows, side="right")
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(rows)),
                        pa.array(n[rows]),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )
        term = np.flatnonzero(totals)
        if len(term):
            offsets = pa.array([0, len(term)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None], pa.int64()),
                    pa.array([-1], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(totals[term])),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    rows = rows.mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")
    return saved(rows, "search-postings")


def weight(documents: int, holding: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _scored(postings: DataFrame, vocabulary: np.ndarray, blocks: list[Block], top: int) -> DataFrame:
    """Each task's best documents of every item: block, item, doc_id, score."""
    spark, size = postings.sparkSession, len(vocabulary)
    totals = postings.filter("n < 0").select(F.inline(F.arrays_zip("terms", "tfs")))
    totals = totals.groupBy("terms").agg(F.sum("tfs").alias("tfs")).toArrow()  # vocabulary + 2 rows
    counts = np.zeros(size + 2, np.int64)
    counts[totals.column("terms").to_numpy()] = totals.column("tfs").to_numpy()
    documents, length = int(counts[size]), int(counts[size + 1])
    weights = np.array([weight(documents, int(df)) for df in counts[:size]], np.int64)
    shared = spark.sparkContext.broadcast((weights, blocks))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, blocks = shared.value
        best = [Best(len(b.items), top) for b in blocks]
        for batch in batches:
            lists, tfs = batch.column(2), batch.column(3)
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
            n = batch.column(1).to_numpy()
            m = 100 - 50 + (50 * n * documents) // length
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(begin))))
            ids = batch.column(0).fill_null(0).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for block, found in zip(blocks, best, strict=True):
                rows = len(block.terms) + len(block.children) + len(block.roots)
                step = min(BLOCK_DOCS, max(1, ACCUMULATOR_BYTES // (8 * rows)))
                for a in range(0, len(n), step):
                    b = min(len(n), a + step)
                    part = slice(begin[a], begin[b])
                    at = np.minimum(np.searchsorted(block.terms, term[part]), len(block.terms) - 1)
                    hit = block.terms[at] == term[part]
                    column = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
                    partial = np.zeros((len(block.terms), b - a), np.int64)
                    partial[at[hit], column[hit]] = impact[part][hit]
                    found.add(block.scores(partial), ids[a:b], null[a:b])
        for block, found in zip(blocks, best, strict=True):
            found.merge()
            item, score, ids, null = found.held
            if len(item):
                columns = [
                    pa.array(np.full(len(item), block.number, np.int32)),
                    pa.array(block.items[item]),
                    pa.array(ids, mask=null),
                    pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "item", "doc_id", "score"])

    rows = postings.filter("n >= 0").mapInArrow(search, "block int, item bigint, doc_id bigint, score bigint")
    return _best(_best(rows, top, [F.pmod(F.xxhash64("doc_id", "score"), F.lit(TOP_PARTS))]), top, [])


def _best(rows: DataFrame, top: int, salt: list) -> DataFrame:
    order = Window.partitionBy("block", "item", *salt).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    items, parts = _items(benchmark, item_id, item_text)
    found = None
    for part in range(parts):
        own = items.filter(F.col("part") == part)
        if own.isEmpty():
            continue
        vocabulary, blocks = _plan(own)
        ranked = _scored(_postings(docs, doc_id, text, vocabulary), vocabulary, blocks, top)
        ranked = ranked.join(own.select("block", "item", "item_id"), ["block", "item"])
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        kind = benchmark.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found

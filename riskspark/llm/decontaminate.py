"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

Every benchmark item gets a 256-bit SimHash over its weighted word shingles. Documents slide windows
of exactly an item's size; fingerprints are looked up in a multi-index of 8 blocks of 32 bits. The block
radii r (``block_radii``) satisfy sum(r + 1) = RADIUS + 1: two fingerprints that exceed every block's radius
differ in more than RADIUS bits, so taking all items within the radius of some block finds every fingerprint
within RADIUS, and takes 2 % of random ones. A block's table is searched by xor and bit count over the
items of one size: the values within 7 or 8 bits of a block are far more than a size has items.
Candidates are verified by exact weighted shingle similarity (shared weight over united weight, with repeats).

A window that shares no shingle with an item has similarity 0, so fingerprints are taken only for
windows that hold one of the item's shingles; this leaves out nothing that verification would accept.
At similarity 0.8 about 39 bits differ with a deviation of 6; RADIUS is five deviations above.
Long ranges of windows are taken in slices, so memory follows the item's size and not the document's.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. A shingle that f items
share weighs 1 / f, any other 1. Items of the same words count once in f, so repeating an item changes
no match.

The index is built in the driver from at most ``INDEX_BYTES`` of benchmark text; a larger benchmark is
cut into parts by a hash of the item, and all documents are searched once per part. The weights are
counted once over the whole benchmark and are the same in every part, so the parts together give exactly
the matches of one index. Shared shingles (f > 1) are held in the driver and broadcast, 16 bytes each.

Defined results: NULL text is empty; an empty item matches nothing; an item shorter than the shingle is
one shingle and matches the same run of words; a document shorter than an item is one window. One row
per (document id, item id) that matches, with the most similar window (the first of equals). Rows that
share an id count together; rows or items without an id are named by NULL.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import whole
from riskspark.llm.words import U64, chunks, mix, shingles, word_hashes

SIZE = 5
SIMILARITY = 0.8
BITS = 256
BLOCKS = BITS // 32
RADIUS = 68
INDEX_BYTES = 16 << 20
WINDOWS = 4096  # window starts per slice, at least the item's size
CELLS = 1 << 20  # fingerprint pairs compared at once
_FILTER_BITS = 22


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 rows of BITS columns, one row per shingle."""
    words = np.stack([mix(hashes + U64(0x1234567 * (i + 1))) for i in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def block_radii(radius: int) -> list[int]:
    """Radius per block, with sum(r + 1) = radius + 1 (-1: the block accepts nothing)."""
    least, more = divmod(radius + 1 - BLOCKS, BLOCKS)
    return [least + (b < more) for b in range(BLOCKS)]


def within_blocks(found: np.ndarray, prints: np.ndarray, radii: list[int]) -> np.ndarray:
    """Whether some block of a found fingerprint (rows) is within its radius of an item's (columns)."""
    out = np.zeros((len(found), len(prints)), bool)
    for b, radius in enumerate(radii):
        out |= np.bitwise_count(found[:, b, None] ^ prints[None, :, b]) <= radius
    return out


class Weights:
    """1 / f of the shingles that several items share; any other shingle weighs 1."""

    def __init__(self, hashes: np.ndarray, frequency: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], 1.0 / frequency[order]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            shared = self.hashes[at] == hashes
            out[shared] = self.values[at[shared]]
        return out


def shared_weights(items: DataFrame) -> Weights:
    """Weights over all items (column body): f counts the distinct word sequences that hold a shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column(0)):
                words, at = word_hashes(_lowered(batch.column(0).slice(low, high - low)), alnum_only=True)
                own = [words[a:b] for a, b in pairwise(at)]
                held = [np.unique(shingles(w, SIZE)) for w in own]
                names = [int.from_bytes(blake2b(w.tobytes(), digest_size=8).digest(), "little", signed=True) for w in own]
                columns = [np.concatenate(held).view(np.int64), np.repeat(np.array(names, np.int64), [len(h) for h in held])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "item"])

    found = items.select("body").mapInArrow(cut, "shingle long, item long").distinct()
    shared = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").toArrow()
    return Weights(shared["shingle"].to_numpy().view(U64), shared["f"].to_numpy())


class Index:
    """Items by size, their shingles as anchors, and the multi-index over their fingerprints."""

    def __init__(self, ids: list, texts: list[str], size: int = SIZE, radius: int = RADIUS, weight: Weights | None = None):
        self.size, self.radius, self.radii = size, radius, block_radii(radius)
        self.weight = weight or Weights(np.zeros(0, U64), np.zeros(0))
        self.ids, self.lengths, self.shingles = [], [], []
        bodies = _lowered(pa.array(texts, pa.string()))
        for low, high in chunks(bodies):
            words, at = word_hashes(bodies.slice(low, high - low), alnum_only=True)
            for item, (first, last) in zip(ids[low:high], pairwise(at.tolist()), strict=True):
                if first < last:
                    self.ids.append(item)
                    self.lengths.append(last - first)
                    self.shingles.append(shingles(words[first:last], size))
        by_width, by_length = defaultdict(list), defaultdict(list)
        for i, n in enumerate(self.lengths):
            by_width[min(size, n)].append(i)
            by_length[n].append(i)
        # per width of shingles: the sorted shingles, a quick filter, and the sizes of the items that hold each
        self.anchors = {}
        for width, items in by_width.items():
            held = np.concatenate([self.shingles[i] for i in items])
            sizes = np.repeat([self.lengths[i] for i in items], [len(self.shingles[i]) for i in items]).astype(np.int32)
            order = np.lexsort((sizes, held))
            held, sizes = held[order], sizes[order]
            new = np.ones(len(held), bool)
            new[1:] = (held[1:] != held[:-1]) | (sizes[1:] != sizes[:-1])
            held, sizes = held[new], sizes[new]
            keys, starts = np.unique(held, return_index=True)
            quick = np.zeros(1 << _FILTER_BITS, bool)
            quick[keys >> U64(64 - _FILTER_BITS)] = True
            self.anchors[width] = (keys, quick, np.append(starts, len(held)), sizes)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, items in by_length.items():
            prints = np.stack([self.fingerprints(self.shingles[i], len(self.shingles[i]))[0] for i in items])
            self.groups[n] = (np.array(items), prints)

    def fingerprints(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Fingerprint (a 32-bit number per block) of every run of ``width`` shingles.

        Weights are whole multiples of 2**-30 here: sums are exact, wherever the hashes begin.
        """
        running = np.zeros((len(hashes) + 1, BITS))
        weight = np.maximum(1, np.rint(self.weight(hashes) * 2**30))
        np.cumsum(_signs(hashes) * weight[:, None], axis=0, out=running[1:])
        return np.packbits(running[width:] - running[: len(hashes) - width + 1] > 0, axis=1).view(np.uint32)

    def similarity(self, item: int, window: np.ndarray) -> float:
        counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for side, hashes in enumerate((self.shingles[item], window)):
            for h in hashes.tolist():
                counts[h][side] += 1
        weights = self.weight(np.array(list(counts), U64)).tolist()
        shared = sum(w * min(c) for w, c in zip(weights, counts.values(), strict=True))
        return shared / sum(w * max(c) for w, c in zip(weights, counts.values(), strict=True))

    def hits(self, width: int, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, size of items) of every anchor shingle among the hashes."""
        keys, quick, starts, sizes = self.anchors[width]
        places = np.flatnonzero(quick[hashes >> U64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(keys, hashes[places]), len(keys) - 1)
        held = keys[at] == hashes[places]
        for p, k in zip(places[held].tolist(), at[held].tolist(), strict=True):
            for n in sizes[starts[k] : starts[k + 1]].tolist():
                yield p, n

    def candidates(self, found: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row of found, row of prints, differing bits) of all pairs within the radius, by rows of found."""
        step = max(1, CELLS // len(prints))
        for at in range(0, len(found), step):
            w, i = np.nonzero(within_blocks(found[at : at + step], prints, self.radii))
            bits = np.bitwise_count(found[at + w] ^ prints[i]).sum(axis=1, dtype=np.int64)
            near = bits <= self.radius
            yield from zip((at + w[near]).tolist(), i[near].tolist(), bits[near].tolist(), strict=True)

    def search(self, words: np.ndarray, touched: dict[int, list[int]]) -> Iterator[tuple[int, int, float, int]]:
        """(item, first word, similarity, differing bits) of the best window per item.

        ``touched``: per size of items, the sorted word positions of their anchors in this document.
        """
        for n, positions in touched.items():
            items, prints = self.groups[n]
            length = min(n, len(words))
            size = min(self.size, length)  # a short item is one shingle of its own width
            width = length - size + 1
            best: dict[int, tuple[float, int, int]] = {}
            for low, high in _sliced(_ranges(positions, length, len(words)), max(WINDOWS, length)):
                own = shingles(words[low : high + length], size)
                for w, i, bits in self.candidates(self.fingerprints(own, width), prints):
                    value = self.similarity(int(items[i]), own[w : w + width])
                    if value >= SIMILARITY - 1e-12 and (i not in best or value > best[i][0] + 1e-12):
                        best[i] = (value, low + w, bits)
            for i, (value, start, bits) in best.items():
                yield int(items[i]), start, value, bits


def _ranges(positions: list[int], length: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Merged ranges (first, last) of window starts that cover some anchor position."""
    last_start = n_words - length
    low = high = -1
    for p in positions:
        first, last = max(0, p - length + 1), min(p, last_start)
        if first > last:
            first = last
        if low < 0:
            low, high = first, last
        elif first <= high + 1:
            high = max(high, last)
        else:
            yield low, high
            low, high = first, last
    if low >= 0:
        yield low, high


def _sliced(ranges: Iterator[tuple[int, int]], step: int) -> Iterator[tuple[int, int]]:
    """The ranges (first, last) in slices of at most ``step`` positions."""
    for low, high in ranges:
        for at in range(low, high + 1, step):
            yield at, min(high, at + step - 1)


def _search_all(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, float, int]]:
    """(row, item, first word, similarity, bits) over a batch of texts."""
    words, at = word_hashes(_lowered(texts), alnum_only=True)
    touched: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for width in index.anchors:
        if len(words) < width:
            continue
        for p, n in index.hits(width, shingles(words, width)):
            row = int(np.searchsorted(at, p, side="right")) - 1
            if p + width <= at[row + 1]:  # else the run crosses into the next text
                touched[row][n].append(p - int(at[row]))
    for row in sorted(touched):
        own = words[at[row] : at[row + 1]]
        for item, start, value, bits in index.search(own, {n: sorted(p) for n, p in touched[row].items()}):
            yield row, item, start, value, bits


def find(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Matches: doc_id, item_id, similarity, first_word, bits."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, bits int"
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), whole(item_text).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = -(-total // INDEX_BYTES)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    found = spark.createDataFrame([], schema)
    if parts:
        weight = shared_weights(items)
        weights = spark.sparkContext.broadcast(weight)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part).toArrow()
        built = Index(rows["id"].to_pylist(), rows["body"].to_pylist(), weight=weight)
        built.weight = None  # broadcast once for all parts
        index = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            built = index.value
            built.weight = weights.value
            for batch in batches:
                out = []
                for low, high in chunks(batch.column(1)):
                    keys = batch.column(0).slice(low, high - low)
                    for row, item, start, value, bits in _search_all(built, batch.column(1).slice(low, high - low)):
                        out.append((keys[row].as_py(), built.ids[item], value, start, bits))
                if out:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "first_word", "bits"])

        found = found.unionByName(texts.mapInArrow(run, schema))
    best = F.max_by(F.struct("similarity", "first_word", "bits"), F.struct("similarity", -F.col("first_word"), -F.col("bits")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")

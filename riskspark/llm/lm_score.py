"""Language-model scores from an Elias-Fano n-gram trie that is spread over the cluster.

The model is a smoothed bigram model over words and an end mark:

    p(v)     = (c(v) + 0.5) / (N + 0.5 (V + 1))
    p(v | w) = (c(w, v) + M p(v)) / (c(w) + M)

with counts over the training documents; a document's first word follows an end mark. The second line
sums to 1 over all words and one unknown word, for every context.

How it runs. Documents are cut into blocks of whole texts; a block holds its distinct word hashes and
its tokens as indices. Level 1: distinct words go to shards by hash, are counted there, numbered, and
counts and numbers go back to the blocks. Level 2: a block's distinct pairs of known words go to shards
by context, each with its count of training tokens; a context too frequent for one shard is split by its
successors. A pair is sent as places in two short sorted lists of words, so that a word's number, count and
probability travel once per block and shard. A shard adds the counts, builds a trie (monotone pointers, coded probabilities,
memory-mapped), looks up every pair and returns its probability to the block, which sums them per
document. The number of shards and blocks follows the corpus. However often a pair occurs, its shard
gets one entry per block: a pair of all blocks adds SHARD_PAIRS entries at about 2 TB of text.

Words are 64-bit hashes. Probabilities are quantised to 1/2048 of a factor of ten, so a score is off by
at most 0.0005 per token.

Defined results: NULL text is empty and has one token, the end mark; A-Z are folded; rows are scored
one by one, also repeated ids; NULL ids fall into fold 0. Without training documents every token has
p = 1 and N is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import saved, whole
from riskspark.llm.elias_fano import CODE_SCALE, Trie
from riskspark.llm.words import U64, chunks, mix, word_hashes

BLOCK_BYTES = 1 << 21
SHARD_WORDS = 500_000
SHARD_PAIRS = 1_000_000
STRENGTH = 50.0
END = 0x5EED0F7E27A1C0DE
UNKNOWN = np.uint32(0xFFFFFFFF)
UNSEEN = 0xFFFF  # code of a pair without training counts


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: small numbers in wide types cost next to nothing."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=5).compress(head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    shapes = np.frombuffer(data, np.int64, 2 * count, 8).reshape(count, 2)
    at, arrays = 8 + 16 * count, []
    for n, char in shapes:
        dtype = np.dtype(chr(char))
        planes = np.frombuffer(data, np.uint8, int(n) * dtype.itemsize, at).reshape(dtype.itemsize, int(n))
        arrays.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += int(n) * dtype.itemsize
    return arrays


def pack_pairs(context: np.ndarray, times: np.ndarray, successor: np.ndarray, prior: np.ndarray, training: np.ndarray) -> bytes:
    """Pairs sorted by (context, successor): the words of each side once, as differences, and pairs as places among them."""
    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    lengths = np.diff(np.append(heads, len(context))).astype(np.uint32)
    words, first, place = np.unique(successor, return_index=True, return_inverse=True)
    place = place.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
    sides = (context[heads], times[heads], words, prior[first].astype(np.int64))
    return pack(*(np.diff(side, prepend=0) for side in sides), lengths, place, training)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, ...]:
    *sides, lengths, place, training = unpack(data)
    context, times, words, prior = (np.cumsum(side) for side in sides)
    return np.repeat(context, lengths), np.repeat(times, lengths), words[place], prior[place], training


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes()


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: block_id, docs (packed ids, flags, lengths), vocab, tokens."""
    schema = "block_id long, docs binary, vocab binary, tokens binary, n_vocab long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in chunks(batch.column(1), BLOCK_BYTES):
                ids, texts, held = (batch.column(i).slice(low, high - low) for i in range(3))
                words, at = word_hashes(texts)
                tokens = np.insert(words, at[1:], U64(END))
                vocab, index = np.unique(tokens, return_inverse=True)
                index = index.astype(np.uint16 if len(vocab) <= 1 << 16 else np.uint32)
                present = np.array([i.is_valid for i in ids])
                members = pack(
                    ids.fill_null(0).to_numpy(), present, held.to_numpy(zero_copy_only=False), np.diff(at).astype(np.int64) + 1
                )
                row = (block, members, vocab.tobytes(), pack(index), len(vocab), len(tokens))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                names = ["block_id", "docs", "vocab", "tokens", "n_vocab", "n_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)
                block += 1

    return docs.mapInArrow(run, schema)


def _training_counts(members: list[np.ndarray], index: np.ndarray, size: int) -> np.ndarray:
    _, _, held, lengths = members
    return np.bincount(index[np.repeat(~held, lengths)], minlength=size).astype(np.int64)


def _level1(blocks: DataFrame, bits: int) -> DataFrame:
    """Per block and shard: numbers and training counts of the block's words, in hash order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                vocab = np.frombuffer(_bytes(batch.column(2)[b]), U64)
                (index,) = unpack(_bytes(batch.column(3)[b]))
                counts = _training_counts(unpack(_bytes(batch.column(1)[b])), index, len(vocab))
                shard = (vocab >> U64(64 - bits)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(vocab)]])
                parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(shard[p.start]) for p in parts], pa.int64()),
                        pa.array([batch.column(0)[b].as_py()] * len(parts), pa.int64()),
                        pa.array([vocab[p].tobytes() for p in parts], pa.binary()),
                        pa.array([pack(counts[p]) for p in parts], pa.binary()),
                    ],
                    names=["shard", "block_id", "words", "counts"],
                )

    def count(rows: pa.Table) -> pa.Table:
        words = [np.frombuffer(_bytes(w), U64) for w in rows["words"]]
        found, index = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.concatenate([unpack(_bytes(c))[0] for c in rows["counts"]])
        totals = np.zeros(len(found), np.int64)
        np.add.at(totals, index, counts)
        known = totals > 0
        # frequent words get small numbers, which cost little wherever they are sent
        order = np.lexsort((found, -totals))
        number = np.empty(len(found), np.uint32)
        number[order] = np.arange(len(found), dtype=np.uint32)
        number[~known] = UNKNOWN
        ends = np.cumsum([len(w) for w in words])
        replies = [pack(number[i], totals[i]) for i in np.split(index, ends[:-1])]
        first = np.arange(len(words)) == 0
        return pa.table(
            {
                "shard": rows["shard"],
                "block_id": rows["block_id"],
                "reply": pa.array(replies, pa.binary()),
                "n_types": pa.array(np.where(first, int(known.sum()), 0), pa.int64()),
                "n_tokens": pa.array(np.where(first, int(totals.sum()), 0), pa.int64()),
            }
        )

    dealt = blocks.select("block_id", "docs", "vocab", "tokens").mapInArrow(deal, "shard long, block_id long, words binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(count, "shard long, block_id long, reply binary, n_types long, n_tokens long")


def _code(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p * CODE_SCALE), 0, 65535).astype(np.uint16)


class Block:
    """One block's tokens with their counts, and its distinct pairs of known words by shard, context, successor.

    A word's number is its rank in its shard times the number of shards, plus the shard.
    """

    def __init__(self, batch: pa.RecordBatch, b: int, word_shards: int, n: int, v: int, shards: int):
        self.id = batch.column(0)[b].as_py()
        self.ids, self.present, self.held, self.lengths = unpack(_bytes(batch.column(1)[b]))
        (index,) = unpack(_bytes(batch.column(2)[b]))
        numbers, counts = [], []
        for part in batch.column(3)[b]:  # in shard order, which is the order of the hashes
            local, totals = unpack(_bytes(part["reply"]))
            numbers.append(np.where(local == UNKNOWN, -1, local.astype(np.int64) * word_shards + part["shard"].as_py()))
            counts.append(totals)
        self.number, self.count = np.concatenate(numbers), np.concatenate(counts)
        self.single = np.log10((self.count + 0.5) / (n + 0.5 * (v + 1)))
        self.index, self.context = index, np.roll(index, 1)  # the last token is an end mark, as before every first word
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.known = (self.count[index] > 0) & (self.count[self.context] > 0)
        self.at = np.flatnonzero(self.known)
        pairs = self.context[self.at].astype(np.int64) * len(self.number) + index[self.at]
        distinct, place = np.unique(pairs, return_inverse=True)
        w, s = np.divmod(distinct, len(self.number))
        pieces = np.ceil(self.count[w] / max(1.0, n / shards / 4)).astype(np.int64)
        spread = mix(self.number[s].astype(U64) + U64(99)) % pieces.astype(U64)
        shard = (mix(self.number[w].astype(U64) * U64(31) + spread) % U64(shards)).astype(np.int64)
        order = np.lexsort((self.number[s], self.number[w], shard))
        self.w, self.s, self.shard = w[order], s[order], shard[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[place]  # of each token in ``at``
        self.training = np.bincount(self.pair, ~self.held[self.doc[self.at]], len(order)).astype(np.uint32)

    def dealt(self) -> list[tuple]:
        """(shard, block, payload): the shard's pairs with contexts' counts, coded p(v) and training counts."""
        if not len(self.w):
            return []
        rows, codes = [], _code(self.single)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.shard)) + 1, [len(self.w)]])
        for low, high in pairwise(cuts):
            w, s = self.w[low:high], self.s[low:high]
            payload = pack_pairs(self.number[w], self.count[w], self.number[s], codes[s], self.training[low:high])
            rows.append((int(self.shard[low]), self.id, payload))
        return rows

    def scored(self, codes: np.ndarray) -> list[pa.Array]:
        """Columns of the result, given the codes of all distinct pairs."""
        times, alone = self.count[self.w], self.single[self.index]
        # a pair without training counts and an unknown word leave the weighted p(v), an unknown context leaves p(v)
        unseen = self.single[self.s] + np.log10(STRENGTH / (times + STRENGTH))
        value = np.where(codes == UNSEEN, unseen, codes / -CODE_SCALE)
        before = self.count[self.context]
        token = alone + np.where(before > 0, np.log10(STRENGTH / (before + STRENGTH)), 0.0)
        token[self.at] = value[self.pair]
        size = len(self.ids)
        return [
            pa.array(self.ids, pa.int64(), mask=~self.present),
            pa.array(self.held, pa.bool_()),
            pa.array(self.lengths, pa.int64()),
            pa.array(np.bincount(self.doc, self.count[self.index] > 0, size).astype(np.int64), pa.int64()),
            pa.array(np.bincount(self.doc, alone, size), pa.float64()),
            pa.array(np.bincount(self.doc, token, size), pa.float64()),
        ]


def _pair_codes(rows: pa.Table) -> pa.Table:
    """Add the training counts of the shard's pairs, build its trie, look up all pairs for every block."""
    parts = [unpack_pairs(_bytes(payload)) for payload in rows["payload"]]
    context, times, successor, prior, training = (np.concatenate(side) for side in zip(*parts, strict=True))
    order = np.lexsort((successor, context))
    first = np.ones(len(order), bool)
    first[1:] = (context[order][1:] != context[order][:-1]) | (successor[order][1:] != successor[order][:-1])
    group = np.cumsum(first) - 1
    counts = np.bincount(group, training[order], int(group[-1]) + 1)
    lead = order[first]
    lower = 10.0 ** (-prior[lead].astype(float) / CODE_SCALE)
    smooth = np.log10((counts + STRENGTH * lower) / (times[lead] + STRENGTH))
    seen = counts > 0
    pair = context[lead], successor[lead]
    trie = Trie(pair[0][seen], pair[1][seen], np.minimum(_code(smooth[seen]), UNSEEN - 1), int(successor.max()) + 1)
    code = trie.lookup(*pair)
    trie.close()
    found = np.empty(len(order), np.uint16)
    found[order] = np.where(code >= 0, code, UNSEEN).astype(np.uint16)[group]
    ends = np.cumsum([len(p[0]) for p in parts])
    codes = [pack(c) for c in np.split(found, ends[:-1])]
    return pa.table({"shard": rows["shard"], "block_id": rows["block_id"], "codes": pa.array(codes, pa.binary())})


def _scored(blocks: DataFrame, replies: DataFrame, word_shards: int, n: int, v: int, shards: int) -> DataFrame:
    """One row per document. Both passes over the blocks read the same shuffle."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [f.split()[0] for f in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                rows = Block(batch, b, word_shards, n, v, shards).dealt()
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "block_id", "payload"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                answers = batch.column(4)[b]
                codes = [unpack(_bytes(a["codes"]))[0] for a in answers] if answers.is_valid else []
                block = Block(batch, b, word_shards, n, v, shards)
                yield pa.RecordBatch.from_arrays(block.scored(np.concatenate([np.zeros(0, np.uint16), *codes])), names=names)

    listed = replies.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("shard", "reply"))).alias("replies"))
    joined = blocks.select("block_id", "docs", "tokens").join(listed, "block_id")
    dealt = joined.mapInArrow(deal, "shard long, block_id long, payload binary")
    coded = dealt.groupBy("shard").applyInArrow(_pair_codes, "shard long, block_id long, codes binary")
    answers = coded.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("shard", "codes"))).alias("answers"))
    return joined.join(answers, "block_id", "left").mapInArrow(finish, schema)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    inputs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"), held_out.alias("held"))
    blocks = saved(_blocks(inputs), "lm-blocks")
    words, tokens = blocks.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    bits = max(4, (words // SHARD_WORDS).bit_length())
    replies = saved(_level1(blocks, bits), "lm-words")
    sizes = replies.agg(F.sum("n_types").alias("types"), F.sum("n_tokens").alias("tokens")).first()
    n, v = sizes["tokens"] or 0, sizes["types"] or 0
    shards = max(16, -(-tokens // SHARD_PAIRS))
    gathered = _scored(blocks, replies, 1 << bits, n, v, shards)
    return gathered.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

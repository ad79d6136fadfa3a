"""Near duplicates: chosen-path set similarity join over word shingles.

Documents with the same shingle set collapse into one class first. Class representatives carry a
signature of minwise hashes. A tree starts by dealing them to nodes by one minwise token; a node with
more than ``NODE`` members branches again, each member going to ``BRANCH`` children by further minwise
tokens, which the node's path selects. Small nodes are compared exhaustively by sketches, and every
candidate is confirmed on the full shingle sets. ``TREES`` independent trees are run.

Recall: a pair at similarity 0.8 misses one root with chance 0.2 and all BRANCH children with 0.008, so
ten trees of up to three branchings miss it with chance below 1e-6; the sketch thresholds lie five
standard deviations below the similarity.

Work is kept linear in large groups of true near duplicates: a first round links only a best spanning
forest inside each node (large nodes in blocks that share one hub); after confirmation, the second
round drops nodes that already lie within one component and compares only across components, by finer
sketches, since the many pairs just below the similarity are of no use there. What is still large after
the last branching is compared block by block, so no candidate is lost to a cap.

Defined results: A-Z are folded, words are runs without ASCII white space; a text with fewer words than
the shingle size is one shingle; an empty or NULL text has none, links with nothing and is kept. One
output row per input row; rows that share an id are one document, which every link of either text
joins. A NULL id has no component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import batches_by_key, bounded, fixed_binary, saved, whole
from riskspark.llm.components import components
from riskspark.llm.words import U64, chunks, mix, odd_numbers, shingles, word_hashes

HASHES = 128
FINE = 1024  # hashes of the second round's sketches
TREES = 10
FIRST_TREES = 3
PATHS = 40  # minwise tokens kept at full width for branching
BRANCH = 3
DEPTH = 3
NODE = 8192  # members compared at once; a node of that size takes some 10 MB


def _minwise(unique: np.ndarray, hashes: int) -> np.ndarray:
    factors = odd_numbers(hashes, 5)
    best = np.full(hashes, np.iinfo(U64).max, U64)
    for at in range(0, len(unique), 512):
        best = np.minimum(best, (unique[at : at + 512, None] * factors[None, :]).min(axis=0))
    return mix(best)


def _sketch(minwise: np.ndarray) -> bytes:
    return (minwise & U64(255)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class hash (two longs), paths and sketch of every row."""
    schema = "doc_id long, n_shingles long, h1 long, h2 long, paths binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column(1)):
                ids, texts = batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)
                words, at = word_hashes(texts)
                count, h1, h2, paths, sketches = [], [], [], [], []
                for i in range(high - low):
                    unique = np.unique(shingles(words[at[i] : at[i + 1]], size))
                    count.append(len(unique))
                    h1.append(int(unique.sum(dtype=U64).view(np.int64)))
                    h2.append(int(mix(unique ^ U64(0xA5A5A5A5)).sum(dtype=U64).view(np.int64)))
                    best = _minwise(unique, HASHES) if len(unique) else np.zeros(0, U64)
                    paths.append((best[:PATHS] >> U64(32)).astype(np.uint32).tobytes())
                    sketches.append(_sketch(best))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in (count, h1, h2)), pa.array(paths, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "paths", "sketch"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(run, schema)


def _value(position) -> F.Column:
    return F.substring("paths", position * 4 + 1, F.lit(4))


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(t), _value(F.lit(t))) for t in range(trees)])
    return classes.select("rep", F.posexplode(keys).alias("tree", "node"))


def _sized(nodes: DataFrame, extra: str | None = None) -> DataFrame:
    """Members of nodes with at least two members (and two components, where given), with the size."""
    measures = [F.count("*").alias("n")]
    if extra:
        measures += [F.min(extra).alias("low"), F.max(extra).alias("high")]
    sizes = nodes.groupBy("node").agg(*measures).filter("n > 1")
    if extra:
        sizes = sizes.filter("low <> high")
    # written, so that the join is between plain shuffles and a hot node can be split
    return nodes.join(saved(sizes.select("node", "n"), "node-sizes"), "node")


def _agreement(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity; one byte agrees by chance once in 256."""
    share = (others == sketch).mean(axis=1)
    return (share - 1 / 256) / (1 - 1 / 256)


def _forest(reps: np.ndarray, sketch: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs that agree at least so much (Prim's order)."""
    best, parent = np.full(len(reps), -1.0), np.zeros(len(reps), np.int64)
    left = np.ones(len(reps), bool)
    edges, at = [], 0
    for _ in range(len(reps) - 1):
        left[at] = False
        found = _agreement(sketch[at], sketch)
        closer = left & (found > best)
        best[closer], parent[closer] = found[closer], at
        at = int(np.argmax(np.where(left, best, -2.0)))
        if best[at] >= least:
            edges.append((int(reps[parent[at]]), int(reps[at])))
    return edges


def _across(
    reps: np.ndarray, sketch: np.ndarray, component: np.ndarray, side: np.ndarray, tree: int, small: np.ndarray, roots: np.ndarray, least: float
) -> list:
    """Pairs in different components (and, in a pair of blocks, on different sides) that agree enough.

    A pair that an earlier tree brings together in a small root node is compared there and left out here.
    """
    edges = []
    mixed = side.min() != side.max()
    earlier = np.arange(tree)
    for i in range(len(reps) - 1):
        rest = np.flatnonzero((component[i + 1 :] != component[i]) & ((side[i + 1 :] != side[i]) | (not mixed))) + i + 1
        met = earlier[(small[i] >> earlier) & 1 == 1]
        if len(rest) and len(met):
            rest = rest[~(roots[rest][:, met] == roots[i, met]).any(axis=1)]
        if len(rest):
            edges.extend((int(reps[i]), int(reps[j])) for j in rest[_agreement(sketch[i], sketch[rest]) >= least])
    return edges


def _least(percent: int, hashes: int) -> float:
    """Estimate below which a pair is no candidate."""
    return percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / hashes) ** 0.5


def _compared(members: DataFrame, percent: int, across: bool) -> DataFrame:
    """Candidate pairs of nodes (node, rep, sketch[, component, side, tree, small, paths]); a node fits one batch."""
    width = FINE if across else HASHES
    least = _least(percent, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_key(batches):
            if not batch.num_rows:
                continue
            node, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sketch = fixed_binary(batch.column(2), np.uint8, width)
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)] if across else []
            paths = fixed_binary(batch.column(7), np.uint32, PATHS) if across else None
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            edges: list[tuple[int, int]] = []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = slice(low, high)
                if across:
                    component, side, tree, small = (m[part] for m in more)
                    edges += _across(reps[part], sketch[part], component, side, int(tree[0]), small, paths[part], least)
                elif high - low > 1:
                    edges += _forest(reps[part], sketch[part], least)
            if edges:
                pairs = np.sort(np.array(edges, np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    columns = ["node", "rep", "sketch"] + (["component", "side", "tree", "small", "paths"] if across else [])
    placed = members.select(columns).repartition("node").sortWithinPartitions("node", "rep")
    return placed.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _first_round(classes: DataFrame, percent: int) -> DataFrame:
    """Spanning-forest candidates; large nodes in blocks that share the node's smallest member."""
    nodes = _sized(_roots(classes, FIRST_TREES))
    block = F.pmod(F.xxhash64("rep", F.lit("block")), F.ceil(F.col("n") / (NODE // 2)).cast("long"))
    small = nodes.filter(F.col("n") <= NODE).select("node", "rep")
    large = saved(nodes.filter(F.col("n") > NODE).select("node", "rep", block.alias("block")), "large-nodes")
    hubs = large.groupBy("node").agg(F.min("rep").alias("rep"), F.max("block").alias("last"))
    hubs = hubs.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    blocks = large.unionByName(hubs).distinct().select(F.xxhash64("node", "block").alias("node"), "rep")
    return _compared(small.unionByName(blocks).join(classes.select("rep", "sketch"), "rep"), percent, across=False)


def _second_round(classes: DataFrame, label: DataFrame, percent: int, fine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates across components: small nodes at once, large ones after branching, the rest in blocks.

    ``fine`` gives (rep, sketch) of the ids it is given.
    """
    known = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = saved(known.withColumn("component", F.coalesce("component", "rep")), "labelled")
    tag = known.select("rep", "component")
    nodes = saved(_sized(_roots(classes, TREES).join(tag, "rep"), "component"), "nodes")
    at_once = F.col("n") <= NODE
    # bit t: the root node of tree t is compared at once
    small = nodes.groupBy("rep").agg(F.sum(F.when(at_once, F.pow(F.lit(2.0), "tree")).otherwise(0.0)).cast("long").alias("small"))
    ready = nodes.filter(at_once).select("node", "rep", "tree", F.lit(0).alias("side"))
    large = nodes.filter(~at_once).select("node", "rep", "tree")
    for depth in range(DEPTH):
        if large.isEmpty():
            break
        position = [F.lit(TREES) + F.pmod(F.xxhash64("node", F.lit(depth), F.lit(j)), F.lit(PATHS - TREES)).cast("int") for j in range(BRANCH)]
        children = F.array(*[F.xxhash64("node", p, _value(p)) for p in position])
        grown = large.join(known, "rep").select("rep", "tree", "component", F.explode(F.array_distinct(children)).alias("node"))
        nodes = saved(_sized(grown, "component"), "branches")
        ready = ready.unionByName(nodes.filter(F.col("n") <= NODE).select("node", "rep", "tree", F.lit(0).alias("side")))
        large = nodes.filter(F.col("n") > NODE).select("node", "rep", "tree", "n")
    else:
        if not large.isEmpty():
            ready = ready.unionByName(_blocks(large))
    ready = saved(ready.join(known.select("rep", "component", "paths"), "rep").join(small, "rep"), "ready-nodes")
    sketches = saved(fine(ready.select("rep")), "fine-sketches")
    return _compared(ready.join(sketches, "rep"), percent, across=True)


def _blocks(large: DataFrame) -> DataFrame:
    """Every pair of blocks of a node becomes a node of its own; inside one block, all are on one side."""
    count = F.ceil(F.col("n") / (NODE // 2)).cast("long")
    mine = F.pmod(F.xxhash64("rep", F.lit("pair")), count)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))
    rows = large.select("node", "rep", "tree", count.alias("count"), mine.alias("mine"))
    rows = rows.select("node", "rep", "tree", "mine", other.alias("other"))
    pair = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select(pair.alias("node"), "rep", "tree", (F.col("mine") < F.col("other")).cast("int").alias("side"))


def _of_ids(docs: DataFrame, ids: DataFrame, size: int, doc_id: str, text: str, value: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, value of its shingle set) of the documents with the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column(1)):
                words, at = word_hashes(batch.column(1).slice(low, high - low))
                found = [value(np.unique(shingles(words[at[i] : at[i + 1]], size))) for i in range(high - low)]
                columns = [batch.column(0).slice(low, high - low), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "value"])

    wanted = saved(ids.toDF("_nd_id").distinct(), "wanted-ids")
    texts = docs.select(F.col(doc_id).cast("long").alias("_nd_id"), whole(text).alias("_nd_text"))
    return texts.join(bounded(wanted), "_nd_id").mapInArrow(run, "id long, value binary").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs with whether their full shingle sets reach it: 100 * shared >= percent * union."""
    pairs = saved(pairs, "candidates")
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(s.as_buffer(), U64) for s in (x, y))
                both = np.sort(np.concatenate([left, right]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    needed = saved(_of_ids(docs, ids, size, doc_id, text, np.ndarray.tobytes), "shingle-sets")
    left = needed.select(F.col("id").alias("a"), F.col("value").alias("x"))
    right = needed.select(F.col("id").alias("b"), F.col("value").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    checked = both.mapInArrow(check, "a long, b long, linked boolean")
    return saved(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")), "checked")


def near_groups(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    marked = saved(signatures(docs, size, doc_id, text), "signatures")
    usable = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.any_value("paths").alias("paths"), F.any_value("sketch").alias("sketch")
    )
    classes = saved(classes, "classes")
    first = confirmed(_first_round(classes, percent), docs, size, percent, doc_id, text)
    label = saved(components(first.filter("linked")), "first-components")

    def fine(ids: DataFrame) -> DataFrame:
        found = _of_ids(docs, ids, size, doc_id, text, lambda unique: _sketch(_minwise(unique, FINE)))
        return found.groupBy(F.col("id").alias("rep")).agg(F.max("value").alias("sketch"))

    rest = _second_round(classes, label, percent, fine).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = confirmed(rest, docs, size, percent, doc_id, text)
    # the first round's components stand for its links, so only new links are added to them
    links = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = components(links.unionByName(second.filter("linked").select("a", "b")))
    named = classes.select("h1", "h2", "n_shingles", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = saved(named.select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "named")
    grouped = usable.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"])
    alone = marked.filter("n_shingles = 0 OR doc_id IS NULL")
    return grouped.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    )

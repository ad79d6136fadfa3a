"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Every step groups only what the step before left ambiguous, and only small signatures are
shuffled. Prefixes are hashed for rows whose length is shared, the full content for rows whose
(length, prefix hash) is shared.

Defined results
* NULL text counts as the empty text; all empty texts are one group.
* Of equal texts the row with the largest id stays; a NULL id is smaller than any other.
* Repeated rows with equal id and equal text are one document: one output row, each row counted
  in ``group_size``. Rows with equal id and different texts are different documents.
* An empty table gives an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import saved, whole

PREFIX_CHARS = 256
# A length takes 8 bytes, a (length, prefix hash) key 16: at most 16 MB are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _measured(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_xd_length", F.octet_length(whole(text)))


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_xd_prefix", F.xxhash64(F.substring(whole(text), 1, PREFIX_CHARS)))


def shared_lengths(docs: DataFrame, text: str = "text") -> tuple[DataFrame, bool]:
    """Lengths in bytes that more than one row has, and whether they may be broadcast."""
    lengths = _measured(docs, text).groupBy("_xd_length").agg(F.count("*").alias("_xd_rows"))
    lengths = saved(lengths.filter("_xd_rows > 1").select("_xd_length"), "exact-lengths")
    return lengths, lengths.count() <= BROADCAST_KEYS


def shared_keys(docs: DataFrame, text: str = "text") -> tuple[DataFrame, bool]:
    """(length, prefix hash) pairs that more than one row has, and whether they may be broadcast."""
    lengths, small = shared_lengths(docs, text)
    if small:
        signatures = _hashed(_measured(docs, text).join(F.broadcast(lengths), "_xd_length", "left_semi"), text)
    else:
        # beyond the broadcast bound prefixes are hashed in the scan, so that a shuffle need not carry texts
        signatures = _hashed(_measured(docs, text), text).select("_xd_length", "_xd_prefix")
        signatures = signatures.join(lengths, "_xd_length", "left_semi")
    by_prefix = signatures.groupBy("_xd_length", "_xd_prefix").agg(F.count("*").alias("_xd_rows"))
    keys = saved(by_prefix.filter("_xd_rows > 1").select("_xd_length", "_xd_prefix"), "exact-keys")
    return keys, keys.count() <= BROADCAST_KEYS


def _split(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a unique (length, prefix) and rows that need the full hash (with ``_xd_full``)."""
    keys, small = shared_keys(docs, text)
    on = ["_xd_length", "_xd_prefix"]
    signed = _hashed(_measured(docs, text), text)
    if small:
        keys = F.broadcast(keys)
        alone = signed.join(keys, on, "left_anti")
        ambiguous = signed.join(keys, on, "left_semi").withColumn("_xd_full", F.sha2(whole(text), 256))
    else:
        # beyond the broadcast bound the hash is taken in the scan, so that a shuffle need not carry texts
        hashed = signed.withColumn("_xd_full", F.sha2(whole(text), 256))
        alone = hashed.join(keys, on, "left_anti")
        ambiguous = hashed.join(keys, on, "left_semi")
    return alone, ambiguous


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per (id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is NULL where the refinement never needed it, unless ``digest_all``.
    """
    alone, ambiguous = _split(docs, text)
    digest = F.sha2(whole(text), 256) if digest_all else F.lit(None).cast("string")
    singles = alone.select(
        F.col(doc_id).alias("doc_id"),
        F.col(doc_id).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        digest.alias("text_sha256"),
    )
    members = saved(
        ambiguous.groupBy(F.col(doc_id).alias("doc_id"), F.col("_xd_full").alias("text_sha256")).agg(
            F.count("*").alias("rows")
        ),
        "exact-members",
    )
    # written, so that both join sides are plain shuffles and a hot group can be split at run time
    groups = saved(
        members.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")),
        "exact-groups",
    )
    grouped = members.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return singles.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, one per distinct text.

    Copies are reduced before the shuffle; among rows with the same id the largest values of the
    other columns (in column order) stay, so the result does not depend on partitioning.
    """
    alone, ambiguous = _split(docs, text)
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    row = F.struct(F.col(doc_id), *[F.col(f"`{c}`") for c in rest], F.col(text))
    winners = ambiguous.groupBy("_xd_length", "_xd_full").agg(F.max(row).alias("_xd_row")).select("_xd_row.*")
    return alone.select(docs.columns).unionByName(winners.select(docs.columns))

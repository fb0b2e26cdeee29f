"""Exact deduplication by progressive refinement, with DataFrame operations only.

Three rounds, each over what the one before left: rows are grouped by byte length, then by the hash of a prefix, and
the whole text is hashed only where both are shared.  The two prefilters are tables of *slots* (a length or hash
modulo a constant), so the broadcast of each has a proven bound at any input size; two groups that meet in a slot
merely survive to the next round, where the full SHA-256 tells them apart.  Only narrow rows (id, length, hash) are
shuffled, never text.  Groups are counted with map-side aggregation and joined back, so a text that makes up a third
of the rows costs one row per map task, and the join's hot side can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: At most so many rows are broadcast: one long each.
LENGTH_SLOTS, PREFIX_SLOTS = 1 << 20, 1 << 21


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
                carry: tuple[str, ...] = (), hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, full_hash`` and the columns of ``carry``.

    Texts are equal when they are identical after lower-casing A-Z only; NULL counts as the empty text.  The largest
    id of a group stays.  ``full_hash`` (hex SHA-256 of the normalised text) is NULL for rows that an earlier round
    already told apart, unless ``hash_all``.  Rows that repeat an id and its text share one verdict.  A NULL id stays
    only where its group has no other id.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), length.alias("_length"),
                       F.pmod(length, F.lit(LENGTH_SLOTS)).cast("long").alias("_length_slot"),
                       *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)))

    lengths = rows.groupBy("_length_slot").count().filter("count > 1").select("_length_slot", F.lit(True).alias("_same_length"))
    by_length = rows.join(F.broadcast(lengths), "_length_slot", "left").withColumn(
        "_prefix_slot", F.when(F.col("_same_length"), F.pmod(
            F.xxhash64("_length", lower_ascii(F.left("_text", F.lit(prefix_chars)))), F.lit(PREFIX_SLOTS))))
    prefixes = (by_length.filter("_same_length").groupBy("_prefix_slot").count().filter("count > 1")
                .select("_prefix_slot", F.lit(True).alias("_same_prefix")))
    hashed = by_length.join(F.broadcast(prefixes), "_prefix_slot", "left").withColumn(
        "_hash", F.when(F.col("_same_prefix"), F.sha2(lower_ascii(F.col("_text")), 256)))

    groups = (hashed.filter(F.col("_hash").isNotNull()).groupBy("_length", "_hash")
              .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1"))
    known = F.coalesce("_hash", F.sha2(lower_ascii(F.col("_text")), 256)) if hash_all else F.col("_hash")
    narrow = hashed.select("_id", "_length", "_hash", known.alias("_full"), *(f"_carry_{i}" for i in range(len(carry))))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return narrow.join(groups, ["_length", "_hash"], "left").select(
        F.col("_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_full").alias("full_hash"),
        *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)))

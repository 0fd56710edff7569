"""Weighted rendezvous sharding with gapless slots, in DataFrame functions only.

Every row draws one score per shard, -weight / ln(u), where u is 32 bits of
md5(key:block); the row goes to the shard of the highest score. A new shard draws its
own scores and leaves the others as they are, so rows move only into it.

Law: `key` - the key and the shard list alone decide. Equal texts under different keys
may lie apart. Defined cases: a null key counts as the text "null"; a null text has no
bytes; a text of any length counts whole; rows with one key share a shard, and each has its own slot; an empty table gives
an empty table. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores taken from one md5: 128 bits give four of 32.
PER_DIGEST = 4
#: Hex digits of the key's digest that name a part of a shard; slots are numbered by part.
SLOT_DIGITS = 2


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard // PER_DIGEST}")))
    part = F.substring(digest, 1 + 8 * (shard % PER_DIGEST), 8)
    u = (F.conv(part, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a text key; ties go to the lower shard, weight 0 gets no rows."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative and one must be positive")
    drawn = [F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*drawn))["shard"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    slot runs from 0 without gaps in each shard, by (digest of the key, key, crc32).
    Rows are numbered within 16**SLOT_DIGITS parts of each shard and the parts' counts
    (a table of at most shards * 16**SLOT_DIGITS rows) are summed, so no task holds a
    whole shard. grown: the weights with further shards, for grown_shard.
    """
    octets = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    name = key_text(key)
    rows = docs.select(
        F.col(key),
        (F.octet_length(octets) + F.lit(8)).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(name, weights).alias("shard"),
        (rendezvous(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(name).alias("digest"),
    ).withColumn("part", F.substring("digest", 1, SLOT_DIGITS))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("digest", F.col(key), "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within).cast("long"))
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )

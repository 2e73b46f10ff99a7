"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks in which the rows of a shard are numbered, so that no shard is one task.
SLOT_BLOCKS = 256


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest of key and salt."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _score(key: Column, i: int, weight: float) -> Column:
    return F.struct((F.lit(-float(weight)) / F.log(_unit(key, str(i)))).alias("score"), F.lit(-i).alias("at"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Struct of the highest score -w / ln(u(key, shard)) and minus its shard; a tie goes to the lower shard.

    A shard's score depends on that shard alone, so one more shard can only take rows into
    itself, and removing one spreads only its own rows. Shards of weight 0 get none.
    """
    scores = [_score(key, i, w) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a positive weight")
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def shard(docs: DataFrame, weights: list[float] | int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Assign every row a shard and a gapless slot in it.

    ``weights`` is a weight per shard, or a number of equal shards. Returns doc_id, size
    (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard (with one more shard of
    mean weight). A null key counts as one key of its own; null and empty texts have size 8
    and checksum 0; repeated rows fall in one shard, each with its slot; other columns are
    ignored. Shards hold even row counts for even weights, as keys are spread by hash.

    Slots number rows by (block of the key's hash, key, checksum): each of a shard's
    SLOT_BLOCKS blocks is numbered on its own, then shifted by the counts of the blocks
    before it. The table of counts has shards x SLOT_BLOCKS rows at most, whatever the input.
    """
    w = [1.0] * weights if isinstance(weights, int) else list(weights)
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
        .select("doc_id", (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
        .withColumn("best", rendezvous(F.col("doc_id"), w))
        .withColumn("shard", (-F.col("best.at")).cast("int"))
        .withColumn("grown_shard", (-F.greatest(F.col("best"), _score(F.col("doc_id"), len(w), sum(w) / len(w)))["at"]).cast("int"))
        .drop("best")
        .withColumn("block", F.floor(_unit(F.col("doc_id"), "slot") * SLOT_BLOCKS).cast("int"))
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(shift), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("shift") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
    )

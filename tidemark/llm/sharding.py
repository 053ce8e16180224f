"""Proportional stratified interleaving: every shard holds the whole table's mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import positioned, unpacked, whole

SHARDS = 16
SEED = "tidemark"


def shuffled(seed: str, doc_id: Column) -> Column:
    """The seeded shuffle: rows of a source are ranked by this digest of their id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Rows are ranked by seeded shuffle within their source, sorted by (rank + 1/2) / rows of the
    source, and cut so that the shards' row counts differ by one at most. A source's share of a shard
    so differs from its share of the table by a row or two. Law `rows`: equal texts are not kept
    together, as a group of copies may be larger than a shard. A missing source is a source of its
    own; a missing id is ranked as the empty text; equal ids go by a digest of their whole rows, and
    rows that are equal throughout are interchangeable. An empty table gives an empty table. Column
    order, other columns and their names are free.
    """
    rows = docs.select(
        whole(docs),
        F.col(f"`{source}`").alias("stratum"),
        shuffled(seed, F.col(f"`{doc_id}`")).alias("draw"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]).alias("tie"),
    )
    ranked = positioned(rows, ["stratum", "draw", "tie"], "strata", within="stratum")
    share = ranked.select(
        "row", "stratum", "position", ((F.col("position") + 0.5) / F.col("total")).alias("share")
    ).withColumnRenamed("position", "rank")
    placed = positioned(share, ["share", "stratum", "rank"], "interleaved")
    shard = f"position * {shards} div total"
    begin = f"(({shard}) * total + {shards - 1}) div {shards}"
    return unpacked(placed, docs.columns, shard=F.expr(shard).cast("int"), slot=F.expr(f"position - {begin}"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The digest of a sharding of documents: size, checksum and law beside each row's place.

    Only ids, sources and digests are shuffled; texts stay where they are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

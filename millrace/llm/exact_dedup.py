"""Exact deduplication by deterministic block naming.

A text is cut into blocks of ``BLOCK_BYTES``. Distinct blocks are sorted and get integers in that order as
names, so equal blocks have equal names and different blocks different ones. Then adjacent pairs of
names are sorted and numbered in turn, level by level, until one name stands for the whole text. Two
texts of one length have the same name exactly if they are identical; no digest decides it.

Blocks are sorted by an 8-byte fingerprint, which brings the names back to the texts; fingerprints that
stand for several blocks are settled by a sort of, and a join on, the blocks themselves. Copies of a
block are merged by the map side of the aggregation, so a block that a third of all texts share reaches
the naming task once from each map task. All text is shuffled once; what follows are integers. A text of n blocks takes part in about log2(n) levels, each of half the rows.

Cases: null text counts as empty; empty texts are equal to each other; a null doc_id is a row like
others and stays only if its group has no other id; rows repeated with one doc_id are counted each
and share one verdict; an empty table gives an empty report; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_PAIRS, checkpointed, is_empty, kept_rows, stored, with_small_side

BLOCK_BYTES = 256


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Each row of ``distinct`` with an integer name; names are in the order of ``keys``."""
    return distinct.orderBy(*keys).withColumn("name", F.monotonically_increasing_id())


def _texts(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return t.select("doc_id", "raw", F.unhex(F.sha2("raw", 256)).alias("sha"), F.octet_length("raw").cast("long").alias("bytes"))


def _blocks(block_bytes: int) -> Column:
    """idx and block of each block of raw; a short last block stays short, and an empty text has an empty one."""
    last = f"greatest(0, cast((bytes - 1) div {block_bytes} as int))"
    return F.posexplode(F.expr(f"transform(sequence(0, {last}), i -> substring(raw, i * {block_bytes} + 1, {block_bytes}))")).alias("idx", "block")


def blocks(docs: DataFrame, block_bytes: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(row, n, idx, print, doc_id, sha, bytes): a row for each of the n blocks of a text; the last three only with the first block."""
    t = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    t = t.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("int"))
    t = t.select("row", "n", "doc_id", "sha", "bytes", _blocks(block_bytes))
    once = [F.when(F.col("idx") == 0, F.col(c)).alias(c) for c in ("doc_id", "sha", "bytes")]
    return t.select("row", "n", "idx", fingerprint(F.col("block")).alias("print"), *once)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, bytes, name): a row for each row of ``docs``; (bytes, name) is the text's identity."""
    cut = stored(blocks(docs, block_bytes, fingerprint), "blocks")
    rows = cut.filter("idx = 0").select("row", "doc_id", "sha", "bytes")
    alone = _texts(docs).select(_blocks(block_bytes)).select(fingerprint(F.col("block")).alias("print"), "block")
    prints = alone.groupBy("print", "block").agg(F.lit(1)).groupBy("print").agg(F.count(F.lit(1)).alias("alike"))
    names = stored(_named(prints, "print"), "block-names")
    level = cut.join(names.filter("alike = 1").drop("alike"), "print").select("row", "n", "idx", "name")
    unclear = names.filter("alike > 1").select("print")
    if not is_empty(unclear):
        # Several blocks under one fingerprint: names below zero, found by the block itself.
        some = _texts(docs).select("doc_id", "sha", _blocks(block_bytes)).withColumn("print", fingerprint(F.col("block"))).join(with_small_side(unclear), "print")
        told = checkpointed(_named(some.groupBy("block").agg(F.lit(1)), "block").select("block", (-F.col("name") - 1).alias("name")))
        some = some.join(told, "block").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), F.col("idx").alias("__idx"), "name").distinct()
        open_ = cut.select("row", "n", "idx", "print").join(with_small_side(unclear), "print").join(rows, "row")
        found = open_.join(some, open_["doc_id"].eqNullSafe(some["__id"]) & (open_["sha"] == some["__sha"]) & (open_["idx"] == some["__idx"]))
        level = level.unionByName(found.select("row", "n", "idx", "name"))
    level = stored(level, "names")
    done = [level.filter("n = 1").select("row", "name")]
    level = level.filter("n > 1")
    while not is_empty(level):
        pair = level.groupBy("row", "n", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("left"),
            F.max(F.expr("if(idx % 2 = 1, name, null)")).alias("right"),
        )
        # A last name without a partner pairs with the least long, which names no block.
        pair = stored(pair.withColumn("right", F.coalesce("right", F.lit(-(2**63)))).withColumn("n", F.expr("(n + 1) div 2").cast("int")), "pairs")
        names = stored(_named(pair.groupBy("left", "right").agg(F.lit(1)), "left", "right").select("left", "right", "name"), "pair-names")
        level = stored(pair.join(names, ["left", "right"]).select("row", "n", "idx", "name"), "names")
        done.append(level.filter("n = 1").select("row", "name"))
        level = level.filter("n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(rows, "row").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "bytes", "name")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest doc_id stays."""
    rows = checkpointed(identities(docs, block_bytes, fingerprint))
    groups = checkpointed(rows.groupBy("bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, ["bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, bound: int = BROADCAST_PAIRS, **options) -> DataFrame:
    """One row of ``docs`` for each text, that of the largest doc_id; all columns stay."""
    verdicts = exact_dedup(docs, **options).select("doc_id", F.unhex("text_sha256").alias("text_digest"), "kept")
    return kept_rows(docs, checkpointed(verdicts), bound)

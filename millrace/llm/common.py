"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many may be broadcast (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of an id and a digest up to this many may be broadcast (about 25 MB); more are joined by a shuffle.
BROADCAST_PAIRS = 250_000
#: Rows of text in a batch to Python.
ARROW_ROWS = 1000
#: Bytes in a batch to Python, and those of text that an operator takes at once.
ARROW_BYTES, SLICE_BYTES = 16 << 20, 4 << 20
#: ASCII white space between words; a word is a longest run of anything else.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see; where none is set, a temporary one for a local master, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back, so its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the cluster's shared folder and read back, so its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batch: pa.RecordBatch, column: int, rows: int = ARROW_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in order in parts of at most ``rows`` rows whose texts have about ``size`` bytes; a larger text is a part of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and (i - first == rows or held + n > size):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


def in_arrow(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: mapInArrow with batches bounded in rows and bytes, as texts are large rows.

    Batch sizes are settings of the session, read when the query runs. At the end of a task its
    worker hands freed memory back, as it may wait for long.
    """

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def apply(df: DataFrame) -> DataFrame:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return df.mapInArrow(whole, schema)

    return apply


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def with_small_side(small: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``small`` marked for broadcast if it has been counted and has at most ``bound`` rows; else as it is."""
    return F.broadcast(small) if small.count() <= bound else small


def text_digest(text: Column) -> Column:
    """SHA-256 of ``text``; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def kept_rows(docs: DataFrame, verdicts: DataFrame, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """``docs`` without the rows that ``verdicts`` (doc_id, text_digest, kept) drop, and one row for each kept pair.

    A verdict holds for the rows of its doc_id and text, not for others of its doc_id; a null doc_id
    is an id like others. Rows without a verdict stay. Of rows that repeat with one doc_id and one
    text the one whose columns sort first stays. Up to ``bound`` dropped pairs are broadcast so that
    the texts stay where they are; above it both sides are shuffled.
    """

    def joined(pairs: DataFrame, how: str) -> DataFrame:
        right = with_small_side(pairs.select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest")), bound)
        return docs.join(right, docs["doc_id"].eqNullSafe(right["__id"]) & (text_digest(docs["text"]) == right["__digest"]), how)

    pairs = ["doc_id", "text_digest"]
    dropped = checkpointed(verdicts.filter("not kept").select(*pairs).distinct())
    repeated = checkpointed(verdicts.filter("kept").groupBy(*pairs).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*pairs))
    if is_empty(repeated):
        return docs if is_empty(dropped) else joined(dropped, "left_anti")
    once = joined(dropped.unionByName(repeated), "left_anti")
    one = joined(repeated, "left_semi").groupBy("doc_id", text_digest(F.col("text")).alias("__digest")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return once.unionByName(one.select("__row.*"))

"""Similarity join on the Jaccard index of word shingles, with Bayesian candidate pruning.

1. Texts with the same words in the same order (white space and A-Z case aside) are one class; one
   row of it stands for all, so a group of copies of any size costs one signature.
2. Signatures of ``HASHES`` MinHash values are cut into bands. Each map task links the rows of a band
   value to their least, and only that one goes into the shuffle; so candidate links are stars,
   linear in the rows. At a similarity of 0.8 a pair shares no band with a probability of 3e-6, at 0.54 with
   one of a half, at 0.3 with one of 0.97, so texts that share boilerplate alone seldom meet.
3. Components of the stars hold every candidate pair. A component is compared block by block: values
   of the signatures are compared incrementally, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold (uniform prior, Beta posterior) is below
   ``TOLERANCE``. The rest is verified exactly on the shingle sets, by a matrix product where many
   pairs are left. Pairs are counted where they are found and never become rows; of the links of a
   block pair only a spanning star goes on.
4. Components of the verified links are the near-duplicate classes.

Texts of fewer words than a shingle have one shingle of all their words. A component of n different
texts costs n * n / 2 comparisons in all, spread over tasks of ``BLOCK_DOCS`` squared.

Cases: a text without words (null, empty or white space) links to none, not even to its like; null
doc_ids are rows like others and repeated rows are copies; an empty table gives an empty report;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_PAIRS, checkpointed, in_arrow, kept_rows, stored
from millrace.llm.components import connected_components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
HASHES, ROWS, CHECK_EVERY = 252, 6, 8
BLOCK_DOCS, BLOCK_WORDS = 1024, 2_000_000
#: Rows whose bands a task links at a time.
HELD_ROWS = 12_000
#: Members of candidate components up to this many are broadcast (about 15 MB) to pick their texts.
BROADCAST_MEMBERS = 250_000
_MEMO = 150_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


_memo: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in order; of all words if there are fewer."""
    if not words:
        return np.zeros(0, dtype=_U)
    memo = _memo
    if missing := set(words).difference(memo):
        if len(memo) > _MEMO:
            memo.clear()
            missing = set(words)
        memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
    h = np.array([memo[w] for w in words], dtype=_U)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=_U)
    for k in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return _mixed(out)


@lru_cache
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(hashes: np.ndarray, n: int = HASHES) -> np.ndarray:
    """``n`` MinHash values of a set of shingle hashes."""
    a, b = _functions(n)
    x = (hashes >> _U(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * a + b).min(axis=0), out=out)
    return out


@lru_cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of ``n`` equal values with which P(similarity >= threshold) is at least ``tolerance``.

    With m of n values equal the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is
    P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def unpruned(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs of signature rows are left when their values are compared bit by bit."""
    n = left.shape[1]
    same = np.zeros((len(left), len(right)), dtype=np.uint8 if n < 256 else np.uint16)
    alive = np.ones(same.shape, dtype=bool)
    rows, columns = np.arange(len(left)), np.arange(len(right))
    for k in range(n):
        same += left[rows, k, None] == right[None, columns, k]
        if (k + 1) % CHECK_EVERY == 0 or k + 1 == n:
            ok = same >= least_matches(k + 1, threshold, tolerance)
            stay_r, stay_c = ok.any(axis=1), ok.any(axis=0)
            if not stay_r.any():
                return np.zeros((len(left), len(right)), dtype=bool)
            # Dropped pairs never return: their count is pulled below any bound.
            same[~ok] = 0
            if stay_r.mean() < 0.7 or stay_c.mean() < 0.7:
                rows, columns, same = rows[stay_r], columns[stay_c], same[np.ix_(stay_r, stay_c)]
    alive = np.zeros((len(left), len(right)), dtype=bool)
    alive[np.ix_(rows, columns)] = same >= least_matches(n, threshold, tolerance)
    return alive


def linked(sets: list[np.ndarray], pairs: np.ndarray, cut: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Exact verification: which of ``pairs`` (rows: sets before ``cut`` or all, columns: the others) reach the threshold.

    ``sets`` are sorted without repeats; rows are sets[:cut] and columns sets[cut:], or both are all
    sets where cut is len(sets).
    """
    inner = cut == len(sets)
    left, right = (sets, sets) if inner else (sets[:cut], sets[cut:])
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    a, b = (sizes, sizes) if inner else (sizes[:cut], sizes[cut:])
    out = np.zeros(pairs.shape, dtype=bool)
    found = np.argwhere(pairs)
    if len(found) <= 4 * len(sets):
        for i, j in found:
            common = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = common >= threshold * (a[i] + b[j] - common) - 1e-9
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # a shingle of one set is common to no pair
    keep = times[column] > 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros(pairs.shape, dtype=np.float32)
    width = int(times[times > 1].size)
    for low in range(0, width, 1024):
        i, j = np.searchsorted(column, (low, low + 1024))
        x = np.zeros((len(sets), min(1024, width - low)), dtype=np.float32)
        x[owner[i:j], column[i:j] - low] = 1
        common += (x if inner else x[:cut]) @ (x if inner else x[cut:]).T
    return pairs & (common >= threshold * (a[:, None] + b[None, :] - common) - 1e-6)


def signatures(docs: DataFrame, size: int = WORDS, digests: bool = False) -> DataFrame:
    """(key, doc_id, f1, f2, words, signature) for each row: key is unique, f1 and f2 are a digest of its words.

    With ``digests`` also text_digest, the SHA-256 of its text as it stands.
    """
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("words", pa.int64()), ("signature", pa.binary()), *[("text_digest", pa.binary())] * digests])

    def run(batches):
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), [[] for _ in schema]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    f = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype=np.int64) if words else (None, None)
                    sig = signature(shingles(words, size)).tobytes() if words else None
                    row = (key, doc_id, f[0], f[1], len(words), sig)
                    if digests:
                        row += (hashlib.sha256((text or "").encode("utf-8", "replace")).digest(),)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    key += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        _memo.clear()  # the worker may serve other operators next

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.transform(in_arrow(run, "key long, doc_id long, f1 long, f2 long, words long, signature binary" + ", text_digest binary" * digests))


def _band_rows(signed: DataFrame) -> DataFrame:
    """(band, key, lead): a null band is a link from key to lead; else lead stands for its task's rows of the band value."""
    schema = pa.schema([("band", pa.int64()), ("key", pa.int64()), ("lead", pa.int64())])
    bands = HASHES // ROWS

    def stars(keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        key, value = np.repeat(np.concatenate(keys), bands), np.concatenate(values)
        order = np.lexsort((key, value))
        key, value = key[order], value[order]
        first = np.r_[True, value[1:] != value[:-1]]
        lead = key[first][np.cumsum(first) - 1]
        links = np.stack([key[~first], lead[~first]], axis=1)
        links = links[np.lexsort((links[:, 1], links[:, 0]))]
        links = links[np.r_[True, (links[1:] != links[:-1]).any(axis=1)][: len(links)]]
        n, m = int(first.sum()), len(links)
        band = pa.array(np.r_[value[first], np.zeros(m, dtype=np.int64)], mask=np.r_[np.zeros(n, dtype=bool), np.ones(m, dtype=bool)])
        return pa.record_batch([band, pa.array(np.r_[lead[first], links[:, 0]]), pa.array(np.r_[lead[first], links[:, 1]])], schema=schema)

    def run(batches):
        keys, values, held = [], [], 0
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, bands, ROWS // 2)
            value = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (batch.num_rows, bands)).copy()
            for k in range(ROWS // 2):
                value = _mixed(value * _U(0xD6E8FEB86659FD93) + sig[:, :, k])
            keys.append(batch.column(0).to_numpy())
            values.append(value.reshape(-1).astype(np.int64))
            held += batch.num_rows
            if held >= HELD_ROWS:
                yield stars(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield stars(keys, values)

    return signed.select("key", "signature").transform(in_arrow(run, "band long, key long, lead long"))


def candidate_links(signed: DataFrame) -> DataFrame:
    """(a, b): stars that connect all rows of ``signed`` (key, signature) that share a band value."""
    rows = stored(_band_rows(signed), "bands")
    local = rows.filter("band IS NULL").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    leads = rows.filter("band IS NOT NULL")
    least = leads.groupBy("band").agg(F.min("lead").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A band value has as many rows here as tasks met it.
    return local.unionByName(leads.join(checkpointed(least), "band").filter("lead != b").select(F.col("lead").alias("a"), "b")).distinct()


def _verified(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(key, docs, texts, to) for each text of a block pair that links to another: weighted and plain links, and a link."""
    schema = pa.schema([("key", pa.int64()), ("docs", pa.int64()), ("texts", pa.int64()), ("to", pa.int64())])

    def compare(rows: list[dict], i: int, j: int) -> pa.RecordBatch | None:
        rows = list({r["key"]: r for r in rows}.values())
        if i != j:
            rows.sort(key=lambda r: r["block"] != i)
        cut = len(rows) if i == j else sum(r["block"] == i for r in rows)
        if len(rows) < 2 or cut == 0:
            return None
        sig = np.frombuffer(b"".join([r["signature"] for r in rows]), dtype=np.uint32).reshape(len(rows), -1)
        pairs = unpruned(sig, sig, threshold, tolerance) if i == j else unpruned(sig[:cut], sig[cut:], threshold, tolerance)
        if i == j:
            np.fill_diagonal(pairs, False)
        if not pairs.any():
            return None
        links = linked([np.frombuffer(r["shingles"], dtype=_U) for r in rows], pairs, cut, threshold)
        key, copies = np.array([r["key"] for r in rows]), np.array([r["copies"] for r in rows])
        near = links
        if i != j:
            near = np.zeros((len(rows), len(rows)), dtype=bool)
            near[:cut, cut:], near[cut:, :cut] = links, links.T
        some = near.any(axis=1)
        # Each takes the least label of its neighbours, then the label of its label, so rounds grow with the logarithm of a chain.
        order = np.argsort(key)
        rank, near_in_order = np.arange(len(key)), near[np.ix_(order, order)]
        while True:
            least = np.minimum(rank, np.where(near_in_order, rank[None, :], len(key)).min(axis=1))
            least = least[least]
            if (least == rank).all():
                break
            rank = least
        label = np.empty_like(key)
        label[order] = key[order][rank]
        return pa.record_batch([pa.array(key[some]), pa.array(np.array([copies[row].sum() for row in near[some]], dtype=np.int64)), pa.array(near.sum(axis=1)[some]), pa.array(label[some])], schema=schema)

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if group is not None and group != (r["root"], r["i"], r["j"]):
                    if (out := compare(rows, *group[1:])) is not None:
                        yield out
                    rows = []
                group = (r["root"], r["i"], r["j"])
                rows.append(r)
        if rows and (out := compare(rows, *group[1:])) is not None:
            yield out

    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    spread = spread.select("root", "i", "j", "key", "block", "copies", "signature", "shingles")
    return spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").transform(in_arrow(run, "key long, docs long, texts long, to long"))


def _member_sets(docs: DataFrame, members: DataFrame, size: int, bound: int) -> DataFrame:
    """``members`` with the signature and the sorted shingles of their text, found by doc_id and digest."""
    names = ["root", "blocks", "block", "copies", "key"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("signature", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, keep, sigs, sets = whole.slice(at, 500), [], [], []
                for k, (f1, f2, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (5, 6, 7)), strict=True)):
                    words = words_of(text)
                    if xxhash.xxh3_128_digest(b" ".join(words)) == np.array([f1, f2], dtype=np.int64).tobytes():
                        own = np.unique(shingles(words, size))
                        keep.append(k)
                        sigs.append(signature(own).tobytes())
                        sets.append(own.tobytes())
                yield pa.record_batch([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in range(5)), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    side = members.withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if members.count() <= bound:
        side = F.broadcast(side)
    rows = texts.join(side, texts["doc_id"].eqNullSafe(side["__id"])).select(*[F.col(n).cast("long") for n in names], "f1", "f2", "text")
    return rows.transform(in_arrow(run, ", ".join(f"{n} long" for n in names) + ", signature binary, shingles binary"))


def _classes(docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS, bound: int = BROADCAST_MEMBERS, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ``signatures``, and (f1, f2, copies, class_id, docs, texts) for each different text of a word or more.

    With ``digests`` also stays, the text_digest of the class's row with the least doc_id, and of those the least.
    """
    rows = stored(signatures(docs, size, digests), "signatures")
    full = rows.filter("words > 0")
    # False sorts before true, so a null doc_id comes last.
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_digest")).alias("first")] * digests
    classes = checkpointed(full.groupBy("f1", "f2").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *first))
    first = full.select("key", "doc_id", "f1", "f2", "words", "signature").join(classes.select("key", "copies"), "key")
    links = candidate_links(first)
    labels = connected_components(links)
    sizes = labels.join(full.select(F.col("key").alias("id"), "words"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("w") / block_words)).cast("long"))
    members = labels.join(sizes.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = members.withColumnRenamed("id", "key").join(full.select("key", "doc_id", "f1", "f2"), "key").join(classes.select("key", "copies"), "key")
    members = checkpointed(members.select("root", "blocks", "block", "copies", "key", "doc_id", "f1", "f2"))
    found = checkpointed(_verified(_member_sets(docs, members, size, bound), threshold, tolerance))
    near = connected_components(found.select(F.col("key").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "key")
    counts = found.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    told = classes.join(counts, "key", "left").join(near, "key", "left").withColumn("root", F.coalesce("root", "key"))
    told = checkpointed(told)
    ids = told.groupBy("root").agg(F.min("least").alias("class_id"), *[F.min("first").getField("text_digest").alias("stays")] * digests)
    return rows, checkpointed(told.join(ids, "root").select("f1", "f2", "copies", "class_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("texts"), *["stays"] * digests))


def similarity_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, copies) for each row of ``docs``.

    class_id is the least doc_id that links lead to; n_links counts the other rows at ``threshold`` or
    above, copies included; n_text_links counts different texts; copies are the rows of the same words.
    """
    rows, told = _classes(docs, **options)
    full = rows.filter("words > 0")
    out = full.select("doc_id", "f1", "f2").join(told, ["f1", "f2"])
    out = out.select("doc_id", "class_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"), "copies")
    lone = rows.filter("words = 0").select("doc_id", F.col("doc_id").alias("class_id"), *[F.lit(n).cast("long").alias(c) for n, c in ((0, "n_links"), (0, "n_text_links"), (1, "copies"))])
    return out.unionByName(lone)


def drop_near_copies(docs: DataFrame, bound: int = BROADCAST_PAIRS, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least doc_id; texts without words and all columns stay."""
    rows, told = _classes(docs, digests=True, **options)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_digest") == F.col("stays"))
    verdicts = rows.filter("words > 0").join(told, ["f1", "f2"]).select("doc_id", "text_digest", kept.alias("kept"))
    return kept_rows(docs, checkpointed(verdicts), bound)

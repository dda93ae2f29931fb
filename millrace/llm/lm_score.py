"""Language-model scores: context-tree weighting over bytes, and add-one unigrams of words as a base.

Context tree. A text is lower-cased (A-Z), encoded and ended by byte 255, which UTF-8 never has and
which also fills the context before the first byte. Each byte is eight binary decisions; the node
for a context and the bits decided so far counts zeros and ones. Krichevsky-Trofimov estimates of
all context depths are mixed: a node's weighted probability is half its own estimate's block
probability and half the product of its children's. Counts are those of the training texts and stay
fixed while texts are scored, so the mixture is one number for each gram (``depth`` context bytes and
the byte that follows). A node that training never reached adds no estimate of its own.

The tree holds every context that occurs, so it grows with the corpus, and is a distributed table:
1. Grams are counted; those of held-out texts alone take part with a count of zero.
2. Grams that share their last ``TOP`` + 1 context bytes make up a subtree, which one task weights
   from the deepest contexts up. Contexts of at most ``TOP`` bytes are weighted on the driver: UTF-8
   has fewer than 40,000 pairs of bytes, and only those that occur count.
3. Each subtree is mixed from there down, which gives the log probability of each gram.
4. Texts are scored: grams of at least one in ``FREQUENT`` of all bytes (at most ``FREQUENT`` of them,
   12 bytes each) from a broadcast table, all others by a shuffled join.

Unigrams. A word of at most ``LONGEST`` bytes and of at least one in ``SHARE`` of all tokens (at most
``SHARE`` such words) is scored from a broadcast table; the others by a shuffled join.

Cases: null text counts as empty and is its end alone; rows with a null doc_id are training rows;
repeated rows are scored each; without training texts all estimates are those of no counts; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, in_arrow, shared_folder, slices

DEPTH, TOP, FREQUENT = 5, 2, 1 << 22
SHARE, LONGEST = 1 << 19, 64
END = 255
#: Bytes that one numpy pass takes.
STEP = 1 << 20
#: Grams of whole subtrees that are computed together.
CHUNK = 300_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def lower_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


# ---- counts ----


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; words are bytes."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def told(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(lower_bytes(text).split())
                if len(held) > 400_000:
                    yield told(held)
                    held = Counter()
        yield told(held)

    return docs.select(F.col("text").cast("string")).transform(in_arrow(run, "word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))


def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each after ``depth`` ends and before one, and the places where a symbol is to be read."""
    pad, end = bytes([END]) * depth, bytes([END])
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), dtype=np.uint8)
    lengths = np.fromiter((n for t in texts for n in (depth, len(t) + 1)), dtype=np.int64, count=2 * len(texts))
    return data, np.flatnonzero(np.repeat(np.tile([False, True], len(texts)), lengths))


def _groups(texts: list[bytes], step: int = STEP):
    """Consecutive texts of about ``step`` bytes together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= step:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each place of the texts, and the place where each text begins among them."""
    data, at = _padded(texts, depth)
    gram = np.zeros(len(at), dtype=np.int64)
    for back in range(depth, -1, -1):
        gram = gram << 8 | data[at - back]
    return gram, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``key`` in order, and the sum of ``n`` for each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def gram_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n): how often each run of ``depth`` context bytes and a symbol occurs in the texts that are not held_out.

    A gram is a big-endian integer; grams of held-out texts alone have 0.
    """
    if not 0 < depth <= 6:
        raise ValueError("depth must be 1 to 6")
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in slices(batch, 0):
                raw = [lower_bytes(t) for t in part.column(0).to_pylist()]
                apart = part.column(1).to_pylist()
                for times in (1, 0):
                    if not (texts := [t for t, h in zip(raw, apart, strict=True) if h != bool(times)]):
                        continue
                    gram, _ = _grams(texts, depth)
                    gram.sort()
                    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                    parts.append((gram[first], np.diff(np.r_[first, len(gram)]) * times))
                    held += len(first)
            if held > 2_000_000:
                parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield pa.record_batch([pa.array(x) for x in parts[0]], schema=schema)
                    parts, held = [], 0
        if parts:
            yield pa.record_batch([pa.array(x) for x in _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))], schema=schema)

    return docs.select(F.col("text").cast("string"), "held_out").transform(in_arrow(run, "gram long, n long")).groupBy("gram").agg(F.sum("n").alias("n"))


# ---- model ----


def _lgamma(z: np.ndarray) -> np.ndarray:
    """Natural log of gamma for z > 0: Stirling's series after a shift by 8."""
    w = z + 8
    series = (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
    product = z.copy()
    for k in range(1, 8):
        product *= z + k
    return series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _last(depth: int) -> int:
    """A mask for the last ``depth`` bytes."""
    return (1 << 8 * depth) - 1


class Level(NamedTuple):
    """The nodes of one context depth: a key is the context and eight bits that tell the node of the byte's tree."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    up: np.ndarray  # place of the node of the context that is one byte shorter, in the level above


def tree_levels(gram: np.ndarray, n: np.ndarray, low: int, depth: int) -> list[Level]:
    """Levels ``low`` to ``depth`` of the contexts of ``gram``, for whole subtrees."""
    out: list[Level] = []
    for d in range(depth, low - 1, -1):
        gram, n = _summed(gram & _last(d + 1), n)
        context, symbol = gram >> 8 << 8, gram & 255
        keys = np.concatenate([context | 1 << k | symbol >> (8 - k) for k in range(8)])
        bit = np.concatenate([symbol >> (7 - k) & 1 for k in range(8)])
        keys, at = np.unique(keys, return_inverse=True)
        n8 = np.tile(n, 8).astype(np.float64)
        ones = np.bincount(at, weights=n8 * bit, minlength=len(keys))
        out.append(Level(keys, np.bincount(at, weights=n8, minlength=len(keys)) - ones, ones, np.zeros(0, dtype=np.int64)))
    out.reverse()
    return out[:1] + [level._replace(up=np.searchsorted(above.keys, _above(level.keys, low + i))) for i, (above, level) in enumerate(zip(out, out[1:], strict=False))]


def _above(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys' nodes in contexts of the last ``depth`` bytes."""
    return (keys >> 8 & _last(depth)) << 8 | keys & 255


def weigh(levels: list[Level], below: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log weighted probability of each node of the first level, and for each level the share that its own estimates have.

    ``below``: the sums of the weighted children of the last level; None if that is the deepest.
    """
    shares: list[np.ndarray] = []
    weighted = np.zeros(0)
    for i in range(len(levels) - 1, -1, -1):
        own = log_kt(levels[i].zeros, levels[i].ones)
        if i + 1 < len(levels):
            children = np.bincount(levels[i + 1].up, weights=weighted, minlength=len(own))
        elif below is None:
            weighted = own
            shares.append(np.ones(len(own)))
            continue
        else:
            children = below
        weighted = np.logaddexp(own, children) - math.log(2)
        shares.append(np.exp(own - math.log(2) - weighted))
    return weighted, shares[::-1]


class State(NamedTuple):
    """What a node hands down: the mixture so far, the weight that is left, the share of it that it takes, and its estimate."""

    mixed: np.ndarray
    weight: np.ndarray
    share: np.ndarray
    kt: np.ndarray


def descend(levels: list[Level], shares: list[np.ndarray], state: State | None) -> State:
    """The state at the last level; ``state`` is that of the nodes above the first level's, None if that is the root's."""
    for i, (level, share) in enumerate(zip(levels, shares, strict=True)):
        n = level.zeros + level.ones
        own = (level.ones + 0.5) / (n + 1)
        if state is None:
            state = State(np.zeros(len(own)), np.ones(len(own)), share, own)
            continue
        if i:
            state = State(*(x[level.up] for x in state))
        state = State(state.mixed + state.weight * state.share * state.kt, state.weight * (1 - state.share), share, np.where(n > 0, own, state.kt))
    return state


def gram_scores(gram: np.ndarray, level: Level, state: State) -> np.ndarray:
    """log10 probability of the symbol of each gram after its context; ``level`` is the deepest one."""
    one = np.clip(state.mixed + state.weight * state.kt, 1e-9, 1 - 1e-9)
    log_one, log_zero = np.log10(one), np.log10(1 - one)
    context, symbol = gram >> 8 << 8, gram & 255
    out = np.zeros(len(gram))
    for k in range(8):
        at = np.searchsorted(level.keys, context | 1 << k | symbol >> (8 - k))
        out += np.where(symbol >> (7 - k) & 1, log_one[at], log_zero[at])
    return out


def _subtrees(batches: Iterator[pa.RecordBatch], root: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of whole subtrees from batches in their order: those of one value of the last ``root`` context bytes are together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size < chunk:
            continue
        gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        roots = gram >> 8 & _last(root)
        cut = len(roots) - int((roots[::-1] != roots[-1]).argmax()) if roots[0] != roots[-1] else 0
        if cut:
            yield gram[:cut], n[:cut]
        held, size = [(gram[cut:], n[cut:])], len(gram) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def gram_probabilities(grams: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(gram, n, p): the log10 probability of each gram of ``gram_counts`` in the tree of all of them."""
    top = min(top, depth - 1)
    spark = grams.sparkSession
    whole = F.shiftright("gram", 8).bitwiseAND(_last(top + 1))
    rooted = grams.repartition(whole).sortWithinPartitions(whole)

    def up(batches):
        for gram, n in _subtrees(batches, top + 1):
            levels = tree_levels(gram, n, top + 1, depth)
            weighted, _ = weigh(levels)
            keys, at = np.unique(_above(levels[0].keys, top), return_inverse=True)
            yield pa.record_batch([pa.array(keys), pa.array(np.bincount(at, weights=weighted, minlength=len(keys)))], names=["key", "w"])

    # What comes to the driver: the contexts of ``top`` bytes with the bytes that follow them.
    below = rooted.transform(in_arrow(up, "key long, w double")).groupBy("key").agg(F.sum("w").alias("w")).toArrow()
    short = grams.groupBy(F.col("gram").bitwiseAND(_last(top + 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    levels = tree_levels(short.column(0).to_numpy().astype(np.int64), short.column(1).to_numpy().astype(np.int64), 0, top)
    sums = np.zeros(len(levels[-1].keys))
    sums[np.searchsorted(levels[-1].keys, below.column(0).to_numpy())] = below.column(1).to_numpy()
    upper = spark.sparkContext.broadcast((levels[-1].keys, descend(levels, weigh(levels, sums)[1], None)))
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("p", pa.float32())])

    def down(batches):
        keys, state = upper.value
        for gram, n in _subtrees(batches, top + 1):
            own = tree_levels(gram, n, top + 1, depth)
            at = np.searchsorted(keys, _above(own[0].keys, top))
            last = descend(own, weigh(own)[1], State(*(x[at] for x in state)))
            p = gram_scores(gram, own[-1], last).astype(np.float32)
            yield pa.record_batch([pa.array(gram), pa.array(n), pa.array(p)], schema=schema)

    return rooted.transform(in_arrow(down, "gram long, n long, p float"))


class GramTable:
    """Grams and their log probabilities in open addressing."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, gram: np.ndarray, p: np.ndarray):
        bits = max(4, math.ceil(math.log2(4 * len(gram) + 1)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.p = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.float32)
        rest, slot = np.arange(len(gram)), self._slot(gram)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[taken]], self.p[slot[taken]] = gram[rest[taken]], p[rest[taken]]
            left = np.ones(len(rest), dtype=bool)
            left[taken] = False
            rest, slot = rest[left], slot[left] + 1 & self.mask

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * self._SPREAD >> self.shift).astype(np.int64)

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each of ``gram``, 0 for those that the table lacks, and where these are."""
        slot = self._slot(gram)
        key = self.keys[slot]
        out = self.p[slot]
        open_ = np.flatnonzero(key != gram)
        out[open_] = 0
        missing = [open_[key[open_] == -1]]
        open_ = open_[key[open_] != -1]
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & self.mask
            key = self.keys[slot]
            hit = key == gram[open_]
            out[open_[hit]] = self.p[slot[hit]]
            missing.append(open_[key == -1])
            on = ~hit & (key != -1)
            open_, slot = open_[on], slot[on]
        return out, np.sort(np.concatenate(missing))

    def score(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """log10 probability of each text by the table's grams, and (text, gram, times) of the others."""
        out, rest, before = [], [], 0
        for group in _groups(texts):
            gram, first = _grams(group, depth)
            parts = [self.look_up(gram[i : i + STEP]) for i in range(0, len(gram), STEP)]
            out.append(np.add.reduceat(np.concatenate([p for p, _ in parts]), first, dtype=np.float64))
            at = np.concatenate([m + i * STEP for i, (_, m) in enumerate(parts)])
            text, other = np.searchsorted(first, at, side="right") - 1, gram[at]
            order = np.lexsort((other, text))
            text, other = text[order], other[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (other[1:] != other[:-1])]) if len(at) else at
            rest.append((text[new] + before, other[new], np.diff(np.r_[new, len(at)])))
            before += len(group)
        return np.concatenate(out) if out else np.zeros(0), rest


# ---- scores ----


def score(docs: DataFrame, depth: int = DEPTH, share: int = SHARE, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    train = rows.filter("not held_out")
    counts = checkpointed(word_counts(train))
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = train.count()
    tokens, kinds = stats["n"] + texts, stats["v"] + (1 if texts else 0)
    bottom = math.log10(tokens + kinds + 1)
    spark = docs.sparkSession
    often = (F.col("n") * share >= tokens) & (F.octet_length("word") <= LONGEST)
    words = counts.filter(often).select("word", "n").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(words.column(0).to_pylist(), np.log10(words.column(1).to_numpy() + 1.0).tolist(), strict=True)))
    probabilities = checkpointed(gram_probabilities(checkpointed(gram_counts(rows, depth)), depth))
    total = probabilities.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    usual = (F.col("n") > 0) & (F.col("n") * frequent >= total)
    grams = probabilities.filter(usual).select("gram", "p").toArrow()
    held_grams = spark.sparkContext.broadcast((grams.column(0).to_numpy().astype(np.int64), grams.column(1).to_numpy().astype(np.float32)))
    end = math.log10(texts + 1)
    plain = [("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("upper", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
    schema = pa.schema([*plain, ("rare", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))), ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int32())])))])

    def run(batches):
        top, model = table.value, GramTable(*held_grams.value)
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, 1, 500):
                raw = [lower_bytes(t) for t in batch.column(1).to_pylist()]
                out, rare_words, rare_counts, sizes = [[] for _ in plain], [], [], []
                p, rest = model.score(raw, depth)
                for doc_id, held, text, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), raw, p.tolist(), strict=True):
                    words = text.split()
                    values = list(map(top.get, words))
                    rare = Counter([w for w, v in zip(words, values, strict=True) if v is None])
                    found = [v for v in values if v is not None]
                    row = (key, doc_id, held, len(words) + 1, len(found) + (1 if texts else 0), math.fsum(found) + end, x, len(text))
                    rare_words += rare.keys()
                    rare_counts += rare.values()
                    sizes.append(len(rare))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    key += 1
                tail = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "tf"])
                tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), tail)
                text_of, gram, times = (np.concatenate(c) for c in zip(*rest, strict=True))
                other = pa.StructArray.from_arrays([pa.array(gram), pa.array(times.astype(np.int32))], names=["gram", "tf"])
                other = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text_of, minlength=len(raw)))], pa.int32()), other)
                yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(out, schema, strict=False)), tail, other], schema=schema)

    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    kind = "key long, doc_id long, held_out boolean, n_tokens long, known long, upper double, score double, n_bytes long, rare array<struct<word: binary, tf: long>>, grams array<struct<gram: long, tf: int>>"
    rows.transform(in_arrow(run, kind)).write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.select("key", F.explode("rare").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    rare = rare.join(counts.filter(~often), "word").groupBy("key").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("added"))
    other = scored.select("key", F.explode("grams").alias("r")).select("key", F.col("r.gram").alias("gram"), F.col("r.tf").alias("tf"))
    other = other.join(probabilities.filter(~usual).select("gram", "p"), "gram").groupBy("key").agg(F.sum(F.col("tf") * F.col("p").cast("double")).alias("rest"))
    out = scored.drop("rare", "grams").join(rare, "key", "left").join(other, "key", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("upper") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score", "n_bytes", (-F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

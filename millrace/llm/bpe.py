"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Words are cut where the tokenizers library cuts them: its own pre-tokenizer is asked once, on the
driver, which characters are letters, numbers, white space or none of these, and that table and a
few comparisons of neighbours give all borders of a batch at once. Words tile the texts, so they are
an Arrow array over the texts' own bytes, and each different one is looked up once.

The corpus's frequent words are compiled, with their ids, into a minimal automaton: equal suffixes
share states, and each transition adds a number so that the sum along a word is the word's place
among all words, where its ids lie. The file is put into the shared folder, sent to the workers by
Spark and memory-mapped there, so all workers of a machine share its pages. The different words of
a batch, but for those that the worker remembers, walk the automaton together. Words that it lacks
are merged by the tokenizer's merges, lowest rank first, leftmost first, again together. The lexicon
decides speed only: any lexicon gives the same ids.

A word is frequent from one in ``SHARE`` of all words up, so there are at most ``SHARE`` of them; those
of more than ``LONGEST`` bytes are left to the merges, so at most ``SHARE`` x ``LONGEST`` bytes (16 MB)
come to the driver.

Cases: null text counts as empty and has no ids; the special token's string in a text is the special
token, as the tokenizers library reads it; texts of any length are read whole; null and repeated
doc_ids are rows like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, in_arrow, shared_folder, slices

SHARE, LONGEST = 1 << 18, 64
#: Words that a worker remembers, in each of two generations.
MEMO = 300_000
#: Kinds of characters, as the pre-tokenizer tells them apart.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The endings that the pre-tokenizer keeps with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Beyond these, up to the end of Unicode, no code point is a letter, number or white space in any version so far.
_PROBED = ((0, 0xD800), (0xE000, 0x34000), (0xE0000, 0xE1000))
_NO_RANK = np.int64(1 << 40)


@lru_cache
def character_kinds(tokenizer: str) -> bytes:
    """The kind of each code point, by where the tokenizer's own pre-tokenizer cuts around it."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for first, end in _PROBED:
        for low in range(first, end, 4096):
            points = range(low, min(low + 4096, end))
            starts = np.zeros(5 * len(points) + 1, dtype=bool)
            starts[[span[0] for _, span in cut("".join([f"a{chr(c)}1{chr(c)}!" for c in points]))]] = True
            after, before, beside = starts[1:-1:5], starts[2::5], starts[4::5]
            kinds[low : low + len(points)] = np.where(~after, LETTER, np.where(~before, NUMBER, np.where(~beside, OTHER, SPACE)))
    kinds[0x20] = SPACE  # the one character that joins what follows it
    return kinds.tobytes()


def word_starts(data: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes ``data`` where a word begins; ``first`` are those where a text begins (none is empty)."""
    n = len(data)
    lead = np.flatnonzero(data >= 0xC0)
    kind = kinds[:256][data]
    if len(lead):
        wide, b = data[lead].astype(np.int32), np.r_[data, np.zeros(3, dtype=np.uint8)].astype(np.uint8)
        one, two, three = (b[lead + k].astype(np.int32) & 63 for k in (1, 2, 3))
        size = 2 + (wide >= 0xE0) + (wide >= 0xF0)
        point = np.where(size == 2, (wide & 31) << 6 | one, np.where(size == 3, (wide & 15) << 12 | one << 6 | two, (wide & 7) << 18 | one << 12 | two << 6 | three))
        own = kinds[point]
        kind[lead] = own
        for k in (1, 2, 3):  # the further bytes of a character are of its kind
            more = size > k
            kind[lead[more] + k] = own[more]
    begins = np.zeros(n + 1, dtype=bool)
    begins[first], begins[n] = True, True
    inside = (data & 0xC0) == 0x80
    space = kind == SPACE
    # A run of letters, of numbers or of others begins where the kind changes, but for one blank that joins it.
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) & ~((data[:-1] == 0x20) & ~space[1:])
    # The last character of several white ones is parted from them if a word follows in its text.
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    while len(back := np.flatnonzero(inside[ends])):
        ends[back] -= 1
    start[ends] = True
    start[inside] = False
    start |= begins[:n]
    # Endings after an apostrophe that begins a word.
    marks = np.flatnonzero((data == 0x27) & start)
    padded = np.r_[data, np.zeros(3, dtype=np.uint8)]
    for ending in map(str.encode, ENDINGS):
        hit = marks
        for k, byte in enumerate(ending, 1):
            hit = hit[(padded[hit + k] == byte) & ~begins[np.minimum(hit + k, n)]]
            start[hit + k] = False
        stop = hit + len(ending) + 1
        for k in range(1, len(ending) + 1):
            start[hit + k] = False
        start[stop[stop < n]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Vocabulary, merges and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.start = [vocab[letters[b]] for b in range(256)]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token.encode() not in self.special}
        tokens |= {i: token for token, i in self.special.items()}
        size = max(tokens) + 1
        #: By id: the id as a decimal and a comma, and the bytes that it stands for.
        self.names = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.bytes = pa.array([tokens.get(i, b"") for i in range(size)], pa.large_binary())
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")").split if self.special else None
        # The same merges for many words at once: pairs as numbers in order, and the ranks of pairs of bytes.
        pair = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(pair)
        self.pairs, self.pair_ranks = pair[order], np.array([i for i, _ in self.ranks.values()], dtype=np.int64)[order]
        self.merged = np.zeros(len(pairs), dtype=np.int64)
        self.merged[[i for i, _ in self.ranks.values()]] = [x for _, x in self.ranks.values()]
        self.byte_ids = np.array(self.start, dtype=np.int64)
        self.byte_ranks = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], _NO_RANK)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, of which none is empty, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        short = np.flatnonzero(lengths < 100)
        data = np.frombuffer(b"".join([words[i] for i in short.tolist()]), dtype=np.uint8)
        ids, word = self.byte_ids[data], np.repeat(short, lengths[short])
        rank = np.full(len(ids), _NO_RANK)
        if len(data):
            rank[:-1] = self.byte_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
            rank[:-1][word[1:] != word[:-1]] = _NO_RANK
        done = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(ids)])
            best = np.minimum.reduceat(rank, first)
            if not (best < _NO_RANK).all():
                ready = np.repeat(best == _NO_RANK, size)
                done.append((word[ready], ids[ready]))
                ids, word, rank = ids[~ready], word[~ready], rank[~ready]
                best, size = best[best < _NO_RANK], size[best < _NO_RANK]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(ids) - 1)
                rank[i] = np.where((j > i) & (word[j] == word[i]), self._rank(ids[i], ids[j]), _NO_RANK)
        for i in np.flatnonzero(lengths >= 100).tolist():
            own = np.array(self.merge(words[i]), dtype=np.int64)
            done.append((np.full(len(own), i), own))
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, in O(n log n)."""
        ids = [self.start[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        ranks = self.ranks
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(*ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, new, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ranks.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := ranks.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*found, a))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton's file: sorted words are added one by one, and finished suffixes are shared at once."""
    words = sorted(w for w in entries if w)
    nodes: list[tuple[bool, dict[int, int]]] = []  # final, transitions; numbered when registered
    register: dict[tuple, int] = {}
    path: list[tuple[int, list]] = [(0, [False, {}])]  # (byte that leads here, open node)

    def close(depth: int) -> None:
        while len(path) > depth:
            byte, (final, edges) = path.pop()
            key = (final, *edges.items())
            if key not in register:
                register[key] = len(nodes)
                nodes.append((final, edges))
            path[-1][1][1][byte] = register[key]

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared + 1)
        for byte in word[shared:]:
            path.append((byte, [False, {}]))
        path[-1][1][0] = True
        last = word
    close(1)
    root = len(nodes)
    nodes.append((path[0][1][0], path[0][1][1]))
    counts = np.zeros(len(nodes), dtype=np.int64)
    keys, targets, adds = [], [], []
    for state, (final, edges) in enumerate(nodes):  # targets are registered before their sources
        seen = int(final)
        for byte, target in edges.items():
            keys.append(state << 8 | byte)
            targets.append(target)
            adds.append(seen)
            seen += int(counts[target])
        counts[state] = seen
    starts = np.cumsum([0, *(len(entries[w]) for w in words)], dtype=np.int64)
    parts = [
        np.array([len(nodes), root, len(keys), len(words)], dtype=np.int64), np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int64),
        np.array(adds, dtype=np.int64), np.array([f for f, _ in nodes], dtype=np.int64), starts, np.array([i for w in words for i in entries[w]], dtype=np.int64),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon over a buffer, such as a mapped file."""

    def __init__(self, data):
        a = np.frombuffer(data, dtype=np.int64)
        states, self.root, edges, self.size = map(int, a[:4])
        cut = np.cumsum([4, edges, edges, edges, states, self.size + 1])
        self.keys, self.targets, self.adds, self.final, self.starts = (a[i:j] for i, j in zip(cut, cut[1:], strict=False))
        self.ids = a[cut[-1] :]

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word among the lexicon's words, -1 for one that it lacks. All words step together."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        row = np.flatnonzero(lengths)
        state, total = np.full(len(row), self.root), np.zeros(len(row), dtype=np.int64)
        depth = 0
        while len(row):
            key = state << 8 | text[starts[row] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            row, at, total = row[ok], at[ok], total[ok]
            state, total = self.targets[at], total + self.adds[at]
            depth += 1
            over = lengths[row] == depth
            hit = over & (self.final[state] == 1)
            out[row[hit]] = total[hit]
            row, state, total = row[~over], state[~over], total[~over]
        return out

    def ids_of(self, place: int) -> list[int]:
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()

    def all_ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places``, one after the other, and how many each has."""
        first, size = self.starts[places], self.starts[places + 1] - self.starts[places]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.ids[np.repeat(first, size) + within], size


def _spread(values: pa.Array) -> tuple[list[int], memoryview]:
    """Where each value of a large_binary array ends, after a first 0, and all values in one piece."""
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, dtype=np.int64, count=len(values) + 1).tolist(), memoryview(data or b"")


class Cutter:
    """Cuts texts into the words that the pre-tokenizer makes; special tokens stand alone."""

    def __init__(self, kinds: bytes, merger: Merger):
        self.kinds, self.merger = np.frombuffer(kinds, dtype=np.uint8), merger

    def words(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All words of ``texts`` as numbers of different ones, and how many come before each text and its end."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        units, owner, special = raw, None, []
        if self.merger.cut and any(t in x for t in self.merger.special for x in raw):
            units, owner = [], []
            for i, x in enumerate(raw):
                for part in self.merger.cut(x):
                    if part in self.merger.special:
                        special.append(len(units))
                    units.append(part)
                    owner.append(i)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        stops = np.cumsum(lengths)
        data = np.frombuffer(b"".join(units), dtype=np.uint8)
        begins = stops - lengths
        starts = word_starts(data, begins[lengths > 0], self.kinds) if len(data) else np.zeros(0, dtype=np.int64)
        for i in special:
            starts = np.delete(starts, slice(*np.searchsorted(starts, (begins[i] + 1, stops[i]))))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)])
        if owner is not None:
            stops = np.cumsum(np.bincount(owner, weights=lengths, minlength=len(raw)).astype(np.int64))
        return words.dictionary_encode(), np.r_[0, np.searchsorted(starts, stops)]


class Encoder:
    """Encodes and decodes the texts of a batch, each different word once."""

    def __init__(self, tokenizer: str, lexicon: Lexicon, memo: int = MEMO, kinds: bytes | None = None):
        self.merger, self.lexicon, self.limit = _merger(tokenizer), lexicon, memo
        self.cutter = Cutter(kinds or character_kinds(tokenizer), self.merger)
        self.memo: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.old: dict[bytes, tuple[int, bytes, bytes]] = {}

    def _learn(self, new: list[bytes]) -> None:
        """Remember (number of ids, ids, decoded bytes) of each of the different words ``new``."""
        places = self.lexicon.places(new)
        hits, rest = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        for at, (ids, sizes) in ((hits, self.lexicon.all_ids(places[hits])), (rest, self.merger.merge_all([new[i] for i in rest.tolist()]))):
            (name_ends, names), (byte_ends, decoded) = _spread(self.merger.names.take(pa.array(ids))), _spread(self.merger.bytes.take(pa.array(ids)))
            last = 0
            for i, n, stop in zip(at.tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
                self.memo[new[i]] = (n, bytes(names[name_ends[last] : name_ends[stop]]), bytes(decoded[byte_ends[last] : byte_ends[stop]]))
                last = stop

    def table(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids with commas after them, decoded bytes) for each of the different ``words``."""
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        missing = [w for w in words if w not in memo]
        memo.update((w, old[w]) for w in missing if w in old)
        special = self.merger.special
        memo.update((w, (1, b"%d," % special[w], w)) for w in missing if w in special)
        new = [w for w in missing if w not in memo]
        self._learn(new)
        out = list(map(memo.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del memo[w]  # not worth its room
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text one entry (number of ids, ids joined by commas, decoded bytes), or none if it has no ids."""
        words, bounds = self.cutter.words(texts)
        entries = self.table(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        number = words.indices
        counts = np.r_[0, np.cumsum(np.array([e[0] for e in entries], dtype=np.int64)[number.to_numpy()])][bounds].tolist()
        name_ends, names = _spread(pa.array([e[1] for e in entries], pa.large_binary()).take(number))
        byte_ends, decoded = _spread(pa.array([e[2] for e in entries], pa.large_binary()).take(number))
        bounds = bounds.tolist()
        return [
            [(n - m, str(names[name_ends[a] : name_ends[b] - 1], "ascii"), bytes(decoded[byte_ends[a] : byte_ends[b]]))] if b > a else []
            for a, b, m, n in zip(bounds, bounds[1:], counts, counts[1:], strict=False)
        ]


@lru_cache(1)
def _merger(tokenizer: str) -> Merger:
    return Merger(tokenizer)


_encoders: dict[tuple[str, str], Encoder] = {}


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n): how often each word occurs in all texts; words are bytes."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    kinds = docs.sparkSession.sparkContext.broadcast(character_kinds(tokenizer))

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).cast(schema)

    def run(batches):
        cutter = Cutter(kinds.value, _merger(tokenizer))
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                words = cutter.words([t or "" for t in part.column(0).to_pylist()])[0]
                times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                held.append(pa.table([words.dictionary.cast(pa.binary()), pa.array(times, pa.int64())], schema=schema))
                size += len(times)
                if size > 1_000_000:
                    held = [merged(held)]
                    size = held[0].num_rows
                    if size > 500_000:
                        yield from held[0].to_batches(100_000)
                        held, size = [], 0
        if held:
            yield from merged(held).to_batches(100_000)

    parts = docs.select(F.col("text").cast("string")).transform(in_arrow(run, "word binary, n long"))
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, share: int = SHARE) -> list[bytes]:
    """The words of at most ``LONGEST`` bytes that make up one in ``share`` of all words or more: at most ``share`` of them."""
    counts = checkpointed(word_counts(docs, tokenizer))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [bytes(r["word"]) for r in counts.filter((F.col("n") * share >= total) & (F.octet_length("word") <= LONGEST)).select("word").collect()]


def lexicon_of(words: list[bytes], tokenizer: str) -> bytes:
    """The compiled lexicon of ``words``."""
    merger = _merger(tokenizer)
    words = [w for w in words if w and w not in merger.special]
    ids, sizes = merger.merge_all(words)
    stops = np.cumsum(sizes).tolist()
    ids = ids.tolist()
    return compile_lexicon({w: ids[a:b] for w, a, b in zip(words, [0, *stops], stops, strict=False)})


def lexicon_for(chunks: list[str], tokenizer: str) -> bytes:
    """The compiled lexicon of the words of ``chunks``, each with and without a blank before it."""
    words, _ = Cutter(character_kinds(tokenizer), _merger(tokenizer)).words([x for c in chunks for x in (c, " " + c)])
    return lexicon_of(words.dictionary.to_pylist(), tokenizer)


def publish(spark: SparkSession, data: bytes) -> str:
    """Put ``data`` into the shared folder and let Spark send it to all workers; returns its file name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(docs: DataFrame, tokenizer: str, share: int = SHARE) -> DataFrame:
    """(doc_id, ids, decoded): the ids as decimals joined by commas, and the bytes that they decode to."""
    return _mapped(docs, tokenizer, share, "doc_id long, n_tokens long, ids string, decoded string", lambda n, ids, raw: (n, ids, raw.decode("utf-8", "replace")))


def digests(docs: DataFrame, tokenizer: str, share: int = SHARE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``."""

    def short(n: int, ids: str, raw: bytes) -> tuple[int, str, str]:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()

    return _mapped(docs, tokenizer, share, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", short)


def _mapped(docs: DataFrame, tokenizer: str, share: int, schema: str, shape) -> DataFrame:
    name = publish(docs.sparkSession, lexicon_of(frequent_words(docs, tokenizer, share), tokenizer))
    kinds = docs.sparkSession.sparkContext.broadcast(character_kinds(tokenizer))
    names = [part.split()[0] for part in schema.split(", ")]
    arrow = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)))

    def run(batches):
        key = (tokenizer, name)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(tokenizer, Lexicon.mapped(SparkFiles.get(name)), kinds=kinds.value)
        encoder = _encoders[key]
        for batch in batches:
            for part in slices(batch, 1):
                rows = [shape(*(r[0] if r else (0, "", b""))) for r in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:], strict=True))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_arrow(run, schema))

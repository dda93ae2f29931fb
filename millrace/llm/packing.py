"""Best-fit packing by large-item matching.

Texts become token ids; only those longer than a sequence are cut. What is packed is the histogram
of piece lengths, which has at most ``capacity`` entries whatever the size of the corpus:

1. Lengths above a third of the capacity: at most two go into one sequence. From the longest down,
   each is matched with the longest partner that still fits; what finds none stays alone.
2. Shorter lengths, from the longest down, go into the smallest gap that holds them, and into new
   sequences when there is none.

The plan is a list of runs (length, first rank, sequences, pieces in each, first sequence, offset),
so the driver never sees a document. A piece's rank among those of its length comes from counts by
(length, salt): a length that a third of all pieces have is dealt over many salts.

Cases: null text counts as empty and is one piece, the end id alone; null and repeated doc_ids are
pieces like others; ties in rank are rows that are equal in all that is returned; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, in_arrow, slices

CAPACITY, END_ID = 4096, 1
#: Chunks whose ids a worker remembers; about 80 MB for each of two generations.
MEMO = 400_000
#: All letters below are Latin, Greek or phonetic ones that every Unicode version knows.
_LATIN_END = "\u0250"


def _of_kind(kind: str) -> str:
    """The characters below ``_LATIN_END`` of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(ord(_LATIN_END)) if unicodedata.category(chr(c))[0] == kind)


#: How the tokenizer cuts a chunk of such characters: endings after an apostrophe, letters, single digits, and the rest.
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^{_of_kind('L')}{_of_kind('N')}]+")


#: Kinds of bytes: 1 for ASCII letters and digits, 2 for ASCII marks, 3 for the apostrophe, else 0.
_KIND = np.array([0 if not 32 < b < 127 else 1 if chr(b).isalnum() else 3 if b == 39 else 2 for b in range(256)], dtype=np.uint8)


class ChunkEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never looks across it.

    Texts are split at white space and where a mark begins or ends, and their chunks are numbered by
    Arrow, so each different chunk of a batch is looked up once. A new chunk of letters alone is one word to the tokenizer: such words are
    encoded together and told apart by the ids that end a word. Another chunk of Latin characters is
    put together from its words, digits and marks; any other is encoded as it is.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), memo
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # For lower-case Latin words: the same merges without the steps that leave such words as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of ``words``, which are of lower-case letters alone and in normal form, with its ids."""
        latin = [w for w in words if w.isascii() or max(w) < _LATIN_END]
        yield from zip(latin, self._joined(latin, self.plain), strict=True)
        if len(latin) < len(words):
            others = list(set(words).difference(latin))
            yield from zip(others, self._joined(others, self.tokenizer), strict=True)

    def _joined(self, words: list[str], tokenizer) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            raw = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
            stops = (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1) * 4
            if len(stops) == len(some):
                stops = stops.tolist()
                out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:  # a letter to Python that is none to the tokenizer
                out += self._encode(some)
        return out

    def _whole(self, text: str, lower: str) -> bool:
        """Whether a text must be encoded as it is, as lower-casing or a special token reaches across its chunks."""
        if not text.isascii() and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text)):
            return True
        return "<|" in lower and any(t in lower for t in self.special)

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of the different ``chunks``."""
        if len(self.memo) > self.limit:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        missing = [c for c in chunks if c not in memo]
        memo.update((c, old[c]) for c in missing if c in old)
        missing = [c for c in missing if c not in memo]
        words, rest = [c for c in missing if c.isalpha()], [c for c in missing if not c.isalpha()]
        # Other chunks of Latin characters are made of words, digits and marks.
        parts = {c: _CUT.findall(c) for c in rest if (c.isascii() or max(c) < _LATIN_END) and c.isprintable()}
        new = {x for p in parts.values() for x in p}.difference(memo, words)
        memo.update((x, old[x]) for x in new if x in old)
        new.difference_update(memo)
        memo.update(self._words(words + [x for x in new if x.isalpha()]))
        single = [x for x in new if not x.isalpha()]
        single += [c for c in rest if c not in parts]
        memo.update(zip(single, self._encode(single), strict=True))
        get = memo.__getitem__
        memo.update((c, b"".join(map(get, p))) for c, p in parts.items())
        return list(map(get, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        lower = [t.lower() for t in texts]
        whole = [i for i, (t, low) in enumerate(zip(texts, lower, strict=True)) if self._whole(t, low)]
        for i in whole:
            lower[i] = ""
        split = pc.ascii_split_whitespace(_parted(pa.array(lower, pa.large_string())))
        numbered = split.flatten().dictionary_encode()
        # Text that begins or ends with white space has an empty chunk there, whose ids are none.
        known = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(numbered.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64, count=len(ids) + 1)[split.offsets.to_numpy()].tolist()
        held = memoryview(data) if data else b""
        out = [bytes(held[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for i, raw in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = raw
        return out


def _parted(texts: pa.Array) -> pa.Array:
    """``texts`` with a space wherever an ASCII letter or digit meets an ASCII mark, but for what follows an apostrophe."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1)
    data = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1])) if data else np.zeros(0, dtype=np.uint8)
    kind = _KIND[data]
    before, after = kind[:-1], kind[1:]
    at = np.flatnonzero(((before == 1) & (after >= 2)) | ((before == 2) & (after == 1))) + 1
    moved = offsets + np.searchsorted(at, offsets, side="right")
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(moved), pa.py_buffer(np.insert(data, at, 32))])


_encoders: dict[str, ChunkEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of at most ``capacity`` ids; the end id is the last."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], dtype="<u4").tobytes()
    size = 4 * capacity

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, ChunkEncoder(tokenizer))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for part in slices(batch, 1):
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    for k in range(0, len(raw), size):
                        piece = raw[k : k + size]
                        for column, value in zip(out, (doc_id, k // size, k // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.transform(in_arrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, sequences, pieces in each, first sequence, offset) that pack ``counts`` pieces by length."""
    left = dict(counts)
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside 1 to the capacity")
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first sequence, sequences) by free room
    sequences = 0

    def place(length: int, n: int, each: int, first: int, offset: int, pieces: int | None = None) -> None:
        runs.append((length, rank[length], n, each, first, offset))
        took = n * each if pieces is None else pieces
        rank[length] += took
        left[length] -= took

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, capacity - length) - 1
            while at >= 0 and (large[at] > length or not left[large[at]] or (large[at] == length and left[length] < 2)):
                at -= 1
            partner = large[at] if at >= 0 else None
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            if partner == length:
                place(length, n, 2, sequences, 0)
            else:
                place(length, n, 1, sequences, 0)
                if partner:
                    place(partner, n, 1, sequences, length)
            if room := capacity - length - (partner or 0):
                gaps[room].append((sequences, n))
            sequences += n
    rooms = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        at = bisect.bisect_left(rooms, length)
        new: set[int] = set()
        while left[length] and at < len(rooms):
            room = rooms[at]
            held, rest, each = gaps[room], [], room // length
            for first, n in held:
                if full := min(n, left[length] // each):
                    place(length, full, each, first, capacity - room)
                    gaps[room - each * length].append((first, full))
                    new.add(room - each * length)
                    first, n = first + full, n - full
                if n and left[length]:
                    some = left[length]  # fewer than fill one sequence
                    place(length, 1, some, first, capacity - room)
                    gaps[room - some * length].append((first, 1))
                    new.add(room - some * length)
                    first, n = first + 1, n - 1
                if n:
                    rest.append((first, n))
            gaps[room] = rest
            at += 1
        if some := left[length]:
            each = capacity // length
            if full := some // each:
                place(length, full, each, sequences, 0)
                gaps[capacity - each * length].append((sequences, full))
                new.add(capacity - each * length)
                sequences += full
            if some := left[length]:
                place(length, 1, some, sequences, 0)
                gaps[capacity - some * length].append((sequences, 1))
                new.add(capacity - some * length)
                sequences += 1
        rooms = sorted(r for r in {*rooms, *new} if r and gaps.get(r))
    out = np.array(runs, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with rank, from 0 among those of one length."""
    spark, total = pieces.sparkSession, sum(counts.values())
    group = max(256, min(100_000, total // 2000))
    salts = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()], "length long, salts long")
    # At most as many rows as there are lengths.
    p = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return p.withColumn("rank", place - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``."""
    pieces = checkpointed(token_pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            at = rank - r[:, 1]
            yield pa.record_batch([*b.columns[:5], pa.array(r[:, 4] + at // r[:, 3]), pa.array(r[:, 5] + at % r[:, 3] * length)], schema=schema)

    rows = ranked(pieces, counts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return rows.transform(in_arrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))

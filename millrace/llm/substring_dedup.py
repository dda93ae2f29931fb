r"""Substring deduplication by hashing lines, paragraphs and word windows.

The units of a text are
* its lines of ``MIN_LINE`` words or more,
* its paragraphs (lines between empty ones) of two lines or more that have as many words,
* windows of ``WINDOW`` words and a few more, for passages that begin or end inside a line. A window
  begins at the best of ``SPAN`` neighbouring words (winnowing), and ends at the best of the ``SLACK``
  words from its least length on. Best is one where a sentence begins or ends, then one of the least
  hash. That depends on the words there alone, so two texts that share ``WINDOW`` + ``SPAN`` + ``SLACK``
  words in a row share a window, whatever stands around them and without any punctuation. Of a shared
  passage, up to some ``SPAN`` words at an end that is none of a sentence can stay.

Units are normalised (white space squeezed, lower case) and hashed to 96 bits; equal words have one
digest whatever kind of unit they make up. Digests are grouped over all texts: the earliest
occurrence stays, that is the first one in the text of the least (doc_id, text hash), and the others
are removed, less what windows that stay cover, and reported with offsets in the original text. (A line
that stays may hold windows that stay in an earlier text; these are removed from it.)

Lines of fewer than ``MIN_LINE`` words are left to the rules on line frequency unless a lower bound is
asked for: short lines such as licences repeat in clean documents, and on the check tables a bound of 8
would take text from 48 % of the documents labelled good, this one from 21 %.

Words become numbers, and units sums over them, for a batch of texts at once. Digests are counted with
partial aggregation, so a line that a third of all texts hold reaches the counting task once from each
map task; digests that occur once go no further.

Cases: null and empty texts have no unit and are left alone, short ones have lines alone; texts of any
length are cut whole; rows that repeat with one doc_id and one text are one document, and different
texts of one doc_id are documents each; null doc_ids rank last; an empty table gives an empty report;
columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, in_arrow, shared_folder, slices

MIN_LINE, WINDOW, SPAN, SLACK = 20, 20, 20, 8
#: Kinds of units: lines and paragraphs, or windows; ``AGAIN`` is added for a repeat in its own text.
LINE, PART, AGAIN = 0, 1, 2
_U = np.uint64
#: Odd numbers whose powers weigh the letters of a word and the words of a unit.
_LETTER, _WORDS = _U(0x9E3779B97F4A7C15), (_U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


@lru_cache
def _inverse(odd: int) -> np.uint64:
    return _U(pow(odd, -1, 1 << 64))


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64."""
    known = _powers_of.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U)
        steps[0] = 1
        known = _powers_of[int(base)] = np.multiply.accumulate(steps)
        if n > 1 << 22:  # a very long text is rare, and so large a table is not kept
            del _powers_of[int(base)]
    return known[:n]


@lru_cache(1)
def _white() -> np.ndarray:
    """By code point: whether it is white space."""
    out = np.zeros(0x110000, dtype=bool)
    out[[c for c in range(0x10000) if chr(c).isspace()]] = True
    return out


def _lower(text: str) -> str:
    """``text`` in lower case with as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([x if len(x := c.lower()) == 1 else c for c in text])


class Words:
    """The words of some texts: where each begins and ends, its hash, and where those of each text begin."""

    def __init__(self, texts: list[str]):
        lower = [_lower(t) for t in texts]
        self.sizes = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
        # A line break after each text parts it from the next.
        codes = np.frombuffer("".join([x for t in lower for x in (t, "\n")]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        word = ~_white()[codes]
        edges = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        self.breaks = np.flatnonzero(codes == 10)
        if len(self.start):
            lengths = self.end - self.start
            within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            letters = _mixed(codes[word].astype(_U) + _U(1)) * _powers(_LETTER, int(lengths.max()))[within]
            self.hash = _mixed(np.add.reduceat(letters, np.cumsum(lengths) - lengths) + lengths.astype(_U))
        else:
            self.hash = np.zeros(0, dtype=_U)
        self.stops = np.isin(codes[self.end - 1], [ord(c) for c in ".!?"])
        self.of_text = np.searchsorted(self.start, np.r_[self.first, len(codes)])
        self.sums = []
        for base in _WORDS:
            terms = _mixed(self.hash ^ base) * _powers(base, len(self.hash))
            self.sums.append(np.r_[_U(0), np.cumsum(terms, dtype=_U)])

    def digests(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 96-bit digest of the words from number ``a`` to before ``b``, wherever they stand."""
        out = []
        for base, sums in zip(_WORDS, self.sums, strict=True):
            back = _powers(_inverse(int(base)), len(sums))
            out.append(_mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(_U)).astype(np.int64))
        return out[0], out[1].astype(np.int32)

    def lines(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) of each line and each paragraph of several lines."""
        stops = np.searchsorted(self.start, self.breaks)
        begins = np.r_[0, stops[:-1]]
        full = stops > begins
        # A paragraph ends where a line has no word or a text ends.
        last = np.isin(self.breaks, self.first + self.sizes)
        ends = np.flatnonzero(~full | last)
        first_line = np.r_[0, ends[:-1] + 1]
        a, b, n = begins[first_line], stops[ends], ends - first_line + full[ends]
        several = n > 1
        a, b = np.r_[begins[full], a[several]], np.r_[stops[full], b[several]]
        long = b - a >= min_words
        return a[long], b[long]

    def windows(self, size: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) of each window."""
        counts = np.diff(self.of_text)
        n = len(self.hash)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        value = _mixed(self.hash * _U(3) + np.r_[self.hash[1:], _U(0)]) >> _U(1)
        value[1:][~self.stops[:-1]] |= _U(1 << 63)  # where a sentence begins comes first
        # A window may begin where it ends in the same text; between texts stand values that never win.
        begins = np.arange(n)
        ok = begins + size <= np.repeat(self.of_text[1:], counts)
        text = np.repeat(np.arange(len(counts)), counts)
        place = begins + (text + 1) * (span - 1)
        spaced = np.full(n + (len(counts) + 1) * (span - 1), ~_U(0))
        spaced[place[ok]] = value[ok]
        which = np.full(len(spaced), -1)
        which[place[ok]] = begins[ok]
        # Only whole spans count, or what there is of a text that is shorter than one.
        valid = which >= 0
        short = np.zeros(len(spaced), dtype=bool)
        short[place[self.of_text[:-1][(counts >= size) & (counts - size + 1 < span)]]] = True
        spans = np.flatnonzero((valid[: len(spaced) - span + 1] & valid[span - 1 :]) | short[: len(spaced) - span + 1])
        least = sliding_window_view(spaced, span)[spans].argmin(axis=1) + spans
        chosen = which[least[np.r_[True, least[1:] != least[:-1]][: len(least)]]]
        a = np.unique(chosen[chosen >= 0])
        # A window ends at the best of the next words: where a sentence ends, or else at the least hash.
        value = (self.hash >> _U(1)) | np.where(self.stops, _U(0), _U(1 << 63))
        last = a[:, None] + size - 1 + np.arange(SLACK)
        stop = self.of_text[1:][text[a]][:, None]
        return a, a + size + np.where(last < stop, value[np.minimum(last, n - 1)], ~_U(0)).argmin(axis=1)

    def units(self, min_line: int, window: int, span: int) -> tuple[np.ndarray, ...]:
        """(text, start, end, h1, h2, kind) of each unit, with places in the text."""
        (a, b), (c, d) = self.lines(min_line), self.windows(window, span)
        kind = np.repeat(np.array([PART, LINE], dtype=np.int8), (len(c), len(a)))
        a, b = np.r_[c, a], np.r_[d, b]
        h1, h2 = self.digests(a, b)
        text = np.searchsorted(self.of_text, a, side="right") - 1
        order = np.lexsort((-kind.astype(np.int64), a, h2, h1, text))
        a, b, h1, h2, text, kind = (x[order] for x in (a, b, h1, h2, text, kind))
        again = np.r_[False, (text[1:] == text[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])][: len(a)]
        kind[again] += AGAIN
        keep = ~again | np.r_[True, a[1:] != a[:-1]][: len(a)]  # a line that is a window too counts once
        a, b, h1, h2, text, kind = (x[keep] for x in (a, b, h1, h2, text, kind))
        return text, self.start[a] - self.first[text], self.end[b - 1] - self.first[text], h1, h2, kind


def windows(text: str, min_words: int = WINDOW, span: int = SPAN) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each window of ``text``, in code points, end exclusive."""
    words = Words([text])
    a, b = words.windows(min_words, span)
    h = zip(*(x.tolist() for x in words.digests(a, b)), strict=True)
    return [(int(words.start[i]), int(words.end[j - 1]), repr(x).encode()) for i, j, x in zip(a, b, h, strict=True)]


def _text_hash(text: str) -> int:
    """The number that Spark's xxhash64 gives a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _all_units(docs: DataFrame, min_line: int, window: int, span: int) -> DataFrame:
    """(key, doc_id, start, end, h1, h2, kind): key is the text's hash, kind that of ``Words.units``."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("kind", pa.int8())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, 500):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                text, start, end, h1, h2, kind = Words(texts).units(min_line, window, span)
                key = np.array([_text_hash(t) for t in texts], dtype=np.int64)[text]
                at = pa.array(text)
                yield pa.record_batch([pa.array(key), batch.column(0).take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(kind)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.transform(in_arrow(run, "key long, doc_id long, start int, end int, h1 long, h2 int, kind byte"))


def removed_spans(marks: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """What the repeated units among ``marks`` (start, end, stays) cover, less what the staying ones cover."""

    def union(parts):
        out: list[list[int]] = []
        for a, b in sorted(parts):
            # Between units a gap this short is white space: a unit has white space on both sides.
            if out and a <= out[-1][1] + 2:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    stay = union((a, b) for a, b, s in marks if s)
    out, i = [], 0
    for a, b in union((a, b) for a, b, s in marks if not s):
        while i and stay[i - 1][1] > a:
            i -= 1
        while i < len(stay) and stay[i][0] < b:
            c, d = stay[i]
            if d > a:
                if a < c:
                    out.append((a, c))
                a = max(a, d)
            i += 1
        if a < b:
            out.append((a, b))
    return out


def _spans(docs: DataFrame, min_line: int, window: int, span: int) -> DataFrame:
    """(key, doc_id, spans, removed_chars, first_docs) for each different text of a doc_id from which something is removed."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/units-{uuid.uuid4().hex}"
    _all_units(docs, min_line, window, span).write.parquet(path)
    rows = spark.read.parquet(path)
    # False sorts before true, so a null doc_id comes last.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = rows.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = checkpointed(groups.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.key").alias("first_key")))
    marks = rows.join(groups, ["h1", "h2"])
    marks = marks.withColumn("stays", (F.col("kind") < AGAIN) & F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("key") == F.col("first_key")))
    marks = marks.filter(~F.col("stays") | (F.col("kind") == PART))
    # As many marks as one text has units: those of rows that repeat are the same ones.
    marks = marks.groupBy("key", "doc_id").agg(F.collect_set(F.struct("start", "end", "stays", "first_doc", "kind")).alias("marks"))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("removed_chars", pa.int64()), ("first_docs", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for r in batch.to_pylist():
                spans = removed_spans([(m["start"], m["end"], m["stays"]) for m in r["marks"]])
                if spans:
                    gone = [m for m in r["marks"] if not m["stays"]]
                    gone = [m for m in gone if m["kind"] % AGAIN == PART] or gone
                    firsts = sorted({m["first_doc"] for m in gone if m["first_doc"] is not None})
                    for column, value in zip(out, (r["key"], r["doc_id"], [{"start": a, "end": b} for a, b in spans], sum(b - a for a, b in spans), firsts), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return marks.transform(in_arrow(run, "key long, doc_id long, spans array<struct<start: int, end: int>>, removed_chars long, first_docs array<long>"))


def find_repeats(docs: DataFrame, min_line: int = MIN_LINE, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """(doc_id, spans, removed_chars, first_docs) for each document of ``docs`` from which something is removed.

    spans are (start, end) pairs of the original text; first_docs are the documents where the
    removed windows stay, or the removed lines where no window is removed, in ascending order.
    """
    return _spans(docs, min_line, window, span).drop("key")


def drop_repeats(docs: DataFrame, min_line: int = MIN_LINE, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """``docs`` with their repeated spans cut out of the text; other columns and all rows stay."""
    found = _spans(docs, min_line, window, span).select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    t = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"].cast("string")) == found["__key"]), "left")
    # The text between the spans: before the first, from each one's end to the next one's start, and after the last.
    cut = """array_join(transform(sequence(0, size(__spans)), i -> substring(text, if(i = 0, 0, __spans[i - 1].end) + 1,
             if(i = size(__spans), length(text), __spans[i].start) - if(i = 0, 0, __spans[i - 1].end))), '')"""
    return t.withColumn("text", F.when(F.col("__spans").isNotNull(), F.expr(cut)).otherwise(F.col("text"))).select(*docs.columns)

"""Quality rules: text statistics and the frequency of lines across the documents of a host.

Lines are normalised (ASCII white space squeezed, lower case) and hashed; for each host the number
of different texts that hold a line is counted, so exact copies of one text count once. A line in
more than ``min_docs`` texts and more than ``share`` of the host's texts is boilerplate and is
removed. A document that loses at least ``depleted`` of its words that way is rejected, as is one
that fails the plain rules.

The counts combine on the map side, so a line that every document holds reaches a task once from
each map task. The boilerplate lines are counted and broadcast only up to ``BROADCAST_LINES`` and
``HOST_LINES`` of one host; beyond it they are joined by a shuffle.

Cases: a null text has no words and fails; a null host is the host ''; ties cannot arise; repeated
rows are reported each, and their removed words are those of one; an empty table gives an empty
report; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import GAP, checkpointed, words_of

MIN_DOCS, SHARE, DEPLETED = 20, 0.01, 0.7
#: Boilerplate lines up to this many may be broadcast (24 bytes a line, so 2.4 MB at most) if no host has more of them
#: than ``HOST_LINES``, as each line of a text is looked for among those of its host; else they are joined by a shuffle.
BROADCAST_LINES, HOST_LINES = 100_000, 2_000
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
#: Word positions take the low bits of a packed key, so the high 44 bits are the window's hash.
_BITS = 20


def repeated_words(words: str) -> str:
    """SQL for the number of words in 3-word windows that occur twice or more in the array ``words``.

    Windows are packed as (hash, place) into longs and sorted; neighbours of equal hash are
    compared word by word. Where two different windows meet under one hash, or the text is too
    long for the packing, the windows themselves are sorted. Each part is bound by an aggregate over
    one element, so that it is computed once wherever the optimizer puts the expression.
    """
    mask = (1 << _BITS) - 1
    return f"""
    aggregate(array({words}), 0L, (acc0, w) -> acc0 + CASE WHEN size(w) < 3 THEN 0L ELSE aggregate(
      array(CASE WHEN size(w) > {mask} THEN array(0L) ELSE
        sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {_BITS}) | i)) END),
      0L,
      (acc, s) -> acc + aggregate(
        array(transform(filter(sequence(0, greatest(size(s) - 2, 0)), j -> size(s) > 1 AND shiftright(s[j], {_BITS}) = shiftright(s[j + 1], {_BITS})),
              j -> struct(CAST(s[j] & {mask} AS INT) AS a, CAST(s[j + 1] & {mask} AS INT) AS b))),
        0L,
        (acc2, p) -> acc2 + aggregate(
          array(CASE WHEN size(w) > {mask} OR exists(p, q -> w[q.a] != w[q.b] OR w[q.a + 1] != w[q.b + 1] OR w[q.a + 2] != w[q.b + 2])
                THEN {_slow('w', 'size(w)')}
                ELSE sort_array(array_distinct(concat(transform(p, q -> q.a), transform(p, q -> q.b)))) END),
          0L,
          (acc3, at) -> acc3 + CASE WHEN size(at) = 0 THEN 0L ELSE
            3L + aggregate(sequence(0, size(at) - 1), 0L, (c, k) -> c + CASE WHEN k = 0 THEN 0L ELSE CAST(least(3, at[k] - at[k - 1]) AS BIGINT) END) END))) END)"""


def _slow(words: str, n: str) -> str:
    grams = f"array_sort(transform(sequence(0, {n} - 3), i -> struct({words}[i] AS x, {words}[i + 1] AS y, {words}[i + 2] AS z, i AS i)))"
    same = "(g[j].x = g[j + 1].x AND g[j].y = g[j + 1].y AND g[j].z = g[j + 1].z)"
    return f"""flatten(transform(array({grams}), g -> sort_array(array_distinct(flatten(
      transform(filter(sequence(0, greatest(size(g) - 2, 0)), j -> size(g) > 1 AND {same}), j -> array(g[j].i, g[j + 1].i)))))))"""


def _norm(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, GAP, " ")))


def _hashes(text: Column) -> Column:
    """Hash of each normalised line of ``text``, null for one without a word."""
    norm = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _norm)
    return F.transform(norm, lambda x: F.when(x != "", F.xxhash64(x, F.hash(x))))


def _host() -> Column:
    return F.coalesce(F.col("source"), F.lit("")).alias("__host")


def _copy() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__copy")


def host_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, __host, __copy, place, line): a row for each line that has a word."""
    t = docs.select("doc_id", _host(), _copy(), F.posexplode(_hashes(F.col("text"))).alias("place", "line"))
    return t.filter("line IS NOT NULL")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(__host, line, n_docs): the lines that more than ``min_docs`` and ``share`` of a host's texts hold.

    A host has at most (mean lines of a text) / ``share`` of them.
    """
    counts = host_lines(docs).groupBy("__host", "line").agg(F.countDistinct("__copy").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = docs.select(_host(), _copy()).groupBy("__host").agg(F.countDistinct("__copy").alias("texts"))
    return counts.join(hosts, "__host").filter(F.col("n_docs") > F.col("texts") * share).select("__host", "line", "n_docs")


def mark_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, bound: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with __gone, the places (from 0) of its boilerplate lines among its \\n-split lines."""
    frequent = checkpointed(frequent_lines(docs, min_docs, share).select("__host", "line"))
    size = frequent.groupBy("__host").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    if (size["all"] or 0) <= bound and (size["most"] or 0) <= HOST_LINES:
        by_host = frequent.groupBy("__host").agg(F.collect_list("line").alias("__lines"))
        t = docs.withColumn("__host", _host()).join(F.broadcast(by_host), "__host", "left")
        t = t.withColumn("__hashes", F.when(F.col("__lines").isNotNull(), _hashes(F.col("text"))))
        gone = F.expr("transform(array(__hashes), h -> filter(sequence(0, size(h) - 1), i -> coalesce(array_contains(__lines, h[i]), false)))[0]")
        t = t.withColumn("__gone", F.when(F.col("__lines").isNotNull(), gone).otherwise(F.array().cast("array<int>")))
        return t.drop("__host", "__lines", "__hashes")
    # Places come back by document; each document has a bounded number of lines of its own.
    gone = host_lines(docs).join(frequent, ["__host", "line"]).groupBy("doc_id", "__copy").agg(F.sort_array(F.collect_set("place")).alias("__gone"))
    gone = gone.withColumnRenamed("doc_id", "__id").withColumnRenamed("__copy", "__copy2")
    t = docs.withColumn("__copy", _copy())
    t = t.join(gone, t["doc_id"].eqNullSafe(gone["__id"]) & (t["__copy"] == gone["__copy2"]), "left").drop("__id", "__copy", "__copy2")
    return t.withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))


def _removed(lines: str, gone: str) -> str:
    """SQL for the number of words in the ``lines`` at the places ``gone``."""
    return f"aggregate(array({lines}), 0L, (acc, l) -> aggregate({gone}, acc, (a, i) -> a + size(filter(split(l[i], r'{GAP}'), w -> w != ''))))"


def text_stats(marked: DataFrame) -> DataFrame:
    """doc_id, the plain counts of each text, base_failed and removed_words for each row of ``mark_lines``."""
    t = marked.select("doc_id", "__gone", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = t.select("doc_id", "__gone", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("lines"))
    full = F.filter("lines", lambda x: F.translate(x, _SPACES, "") != "")
    t = t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words("w")).alias("n_repeat_words"),
        F.expr(_removed("lines", "__gone")).alias("removed_words"),
    )
    return t.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED, bound: int = BROADCAST_LINES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept) for each row."""
    stats = text_stats(mark_lines(docs, min_docs, share, bound))
    return stats.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") < F.col("n_words") * depleted))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED, bound: int = BROADCAST_LINES) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without their boilerplate lines; same columns as ``docs``.

    The rules look at the text as it came. Where a line goes, n_chars (if there) becomes the new length.
    """
    t = mark_lines(docs, min_docs, share, bound)
    t = t.withColumn("__w", words_of(F.col("text"))).withColumn("__lines", F.split("text", "\n"))
    t = t.withColumn("__stay", F.expr(f"""transform(array(struct(__w AS w, __lines AS l, __gone AS g)), x -> size(x.w) >= 50 AND {_removed('x.l', 'x.g')} < size(x.w) * {float(depleted)}D
        AND 100 * {repeated_words('x.w')} <= 50 * size(x.w))[0]""")).filter("__stay")
    rest = F.array_join(F.expr("transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i])"), "\n")
    t = t.withColumn("text", F.when(F.size("__gone") > 0, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.when(F.size("__gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return t.select(*docs.columns)

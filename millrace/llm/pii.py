"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four kinds (email, ip, card, phone) are found by their pattern and its check alone. Further kinds
start from a score for their pattern, gain if their checksum holds or a context word stands within
``CONTEXT`` characters before the span, and count from ``ACCEPT`` up: bank account numbers (IBAN,
mod 97), short cards of 13 to 15 digits (Luhn), national numbers of the form 3-2-4, local phone
numbers, access keys and assigned secrets.

Spans come from splitting a text at its matches: pieces and matches alternate, so running lengths
give the places in code points. Patterns have possessive repeats and look-behinds, so a long run of
one character class is read once. Account numbers and short cards are the longest prefix of a run that
holds the check and ends at a border, so what follows them (a BIC, a date) hides none. Everything stays in DataFrame functions and in the row.

Cases: null text counts as empty; a text without a span has an empty list; overlapping spans of
different kinds are all reported and masked together; repeated rows are reported each; an empty
table gives an empty report; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, ACCEPT = 40, 1.0


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL condition on the match m that must hold.
    check: str = "true"
    #: Score of the pattern, and what a context word adds.
    score: float = 1.0
    context: str = ""
    bonus: float = 0.5
    #: What a text must match at all for the kind to be looked for.
    hint: str = "[0-9]"
    #: Characters that the pattern takes where its group 1 looks ahead over a run, and what a prefix of the run must match:
    #: the span is the longest such prefix that ends at a border and holds the check.
    taken: int = 0
    prefix: str = ""


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(split(reverse({_DIGITS}), ''), struct(0 AS s, 0 AS i),
  (acc, d) -> CASE WHEN d = '' THEN acc ELSE struct(
    acc.s + CASE WHEN acc.i % 2 = 0 THEN CAST(d AS INT) WHEN CAST(d AS INT) < 5 THEN 2 * CAST(d AS INT) ELSE 2 * CAST(d AS INT) - 9 END AS s, acc.i + 1 AS i) END,
  acc -> acc.s % 10 = 0)"""
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Letters count as 10 to 35; the first four characters move to the end.
_MOD97 = """aggregate(split(concat(substring(regexp_replace(m, ' ', ''), 5), substring(regexp_replace(m, ' ', ''), 1, 4)), ''), 0,
  (acc, c) -> CASE WHEN c = '' THEN acc WHEN c BETWEEN '0' AND '9' THEN (acc * 10 + ascii(c) - 48) % 97 ELSE (acc * 100 + ascii(c) - 55) % 97 END,
  acc -> acc = 1)"""
_LOCAL = "A-Za-z0-9._%+-"

BASE = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", hint="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"m RLIKE '^{_PART}(?:[.]{_PART}){{3}}$'"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", hint="[+]"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", _MOD97, taken=4, prefix=r"^[A-Z0-9](?:\x20?[A-Z0-9]){14,33}$"),
    Kind("short_card", r"(?<![0-9.-])(?=([0-9](?:[\x20-]?[0-9]){12,14}+[0-9]?))[0-9]", f"{_LUHN}", 0.5, r"(?i)\b(?:card|visa|amex|mastercard|credit|debit|carte|karte|tarjeta)\b", taken=1, prefix=r"^[0-9](?:[\x20-]?[0-9]){12,14}$"),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "true", 0.5, r"(?i)\b(?:ssn|social|security|tax|taxpayer|tin)\b"),
    Kind("local_phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "true", 0.5, r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|ring|telefon|teléfono|téléphone)\b"),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", hint="A[KS]IA"),
    Kind("secret", r"(?i)(?<![A-Za-z0-9_])(?:password|passwd|secret|api_key|apikey|token)\s?[=:]\s?[^\s,;]{6,}+", hint="[=:]"),
)
#: For the leftmost, longest-first reading of spans of all kinds.
ORDER = {k.name: i for i, k in enumerate((*BASE, *MORE))}


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _found(kind: Kind, text: str) -> str:
    """SQL for the array of (kind, start, end) of ``kind`` in the column ``text``, empty where the hint is absent."""
    p = _quoted(kind.pattern)
    near = "0.0D"
    if kind.context:
        near = f"CASE WHEN substring({text}, greatest(1, acc.at + length(x.p) - {CONTEXT} + 1), least({CONTEXT}, acc.at + length(x.p))) RLIKE {_quoted(kind.context)} THEN {kind.bonus}D ELSE 0.0D END"
    accept = f"({kind.score}D + {near} >= {ACCEPT}D)" if kind.context else "true"
    step = f"""(acc, x) -> transform(array(acc.at + length(x.p)), s -> struct(
        s + length(x.m) AS at,
        CASE WHEN {kind.check.replace('(m', '(x.m').replace('m RLIKE', 'x.m RLIKE')} AND {accept}
             THEN array_append(acc.out, struct('{kind.name}' AS kind, s AS start, s + length(x.m) AS end)) ELSE acc.out END AS out))[0]"""
    if kind.taken:
        # A run may hold several spans, so it is not taken whole; what starts inside the span before is part of that.
        prefixes = f"""filter(transform(sequence(length(x.m), 1, -1), k -> struct(k AS n, substring(x.m, 1, k) AS m, substring(x.m, k + 1, 1) AS next)),
            y -> y.m RLIKE {_quoted(kind.prefix)} AND NOT y.next RLIKE '[A-Za-z0-9]' AND {kind.check.replace('(m', '(y.m')})"""
        step = f"""(acc, x) -> transform(array(struct(acc.at + length(x.p) AS s, get({prefixes}, 0).n AS n)), b -> struct(
        b.s + {kind.taken} AS at,
        CASE WHEN b.n IS NOT NULL AND b.s >= coalesce(get(acc.out, size(acc.out) - 1).end, 0) AND {accept}
             THEN array_append(acc.out, struct('{kind.name}' AS kind, b.s AS start, b.s + b.n AS end)) ELSE acc.out END AS out))[0]"""
    none = "CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>)"
    return f"""CASE WHEN {text} RLIKE '{kind.hint}' THEN aggregate(
      transform(array(regexp_extract_all({text}, {p}, {1 if kind.taken else 0})), a -> zip_with(slice(split({text}, {p}, -1), 1, size(a)), a, (p, m) -> struct(p AS p, m AS m)))[0],
      struct(0 AS at, {none} AS out), {step}, acc -> acc.out) ELSE {none} END"""


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = (*BASE, *MORE)) -> DataFrame:
    """``docs`` with __spans, an array of (kind, start, end) in the order of ``kinds``, then start."""
    t = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    for i, k in enumerate(kinds):
        t = t.withColumn(f"__s{i}", F.expr(_found(k, "__t")))
    return t.withColumn("__spans", F.concat(*[F.col(f"__s{i}") for i in range(len(kinds))])).drop("__t", *[f"__s{i}" for i in range(len(kinds))])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``."""
    t = find_spans(docs.select("doc_id", "text"))
    names = [k.name for k in BASE]
    base = F.filter("__spans", lambda s: s["kind"].isin(names))
    count = [F.size(F.filter("__spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}") for n in names]
    return t.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by [KIND]; spans that overlap become one of the first's kind.

    n_chars, if there, is the new length where something was masked. Null text stays null.
    """
    t = find_spans(docs).withColumn("__spans", F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind")))))
    text = """aggregate(__spans, struct(0 AS at, CAST(array() AS ARRAY<STRING>) AS out),
      (acc, s) -> CASE WHEN s.start < acc.at THEN struct(greatest(acc.at, -s.less) AS at, acc.out AS out)
                  ELSE struct(-s.less AS at, concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), concat('[', upper(s.kind), ']'))) AS out) END,
      acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"""
    t = t.withColumn("text", F.when(F.size("__spans") > 0, F.expr(text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return t.select(*docs.columns)

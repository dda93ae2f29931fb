r"""Chat formatting: a hidden Markov model parses transcripts, then turns are rendered canonically.

A transcript is lines of text. A hidden state is a role together with whether the line begins a turn
of it or goes on with one. What is seen of a line is its speaker marker (``User:``, ``[INST]``, ``###
Assistant`` and the like, or none), its length, whether an empty line stands before it, how it ends and
how it starts. Initial, transition and emission probabilities are counts over at most ``SAMPLE`` lines
of labelled conversations, with pseudo-counts that tie each marker to the begin of its role's turns.
The Viterbi path gives turns and roles; what was one piece of the input table and what another is not used.

Lines are sorted over all tasks by range with a key of their own, so a conversation that holds a third of
all lines is dealt over many tasks, whatever its lines are. Of each task the first and the last conversation may reach into
others: they are first reduced to a max-plus matrix (best score from each state before to each state
at the end), at most two for each task; the driver multiplies those of one conversation in order, which fixes
the states at the seams, and then each task decodes between them.

The result has a row for each line, and the canonical form of a conversation is its ``rendered`` in order, so no
turn is ever put together in one place.

Cases: null text is an empty line; empty lines have no row, but stay inside a turn; a null conv_id is a
conversation of its own and a null turn number comes first; pieces of one number are ordered by hash and text;
rows repeated are pieces each; an empty table gives no rows; roles are never read when turns are
recovered; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, in_arrow

ROLES = ("system", "user", "assistant")
SAMPLE = 20_000
#: Names that speakers go by, by role.
NAMES = {
    "system": ("system", "instructions", "instruction", "context", "sys"),
    "user": ("user", "human", "customer", "prompter", "question", "client", "student", "inst", "q"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "gpt", "model", "agent", "answer", "response", "teacher", "a"),
}
_ANY = "|".join(n for names in NAMES.values() for n in names)
#: A name between decoration and a colon, or one in brackets or after hashes.
MARKER = rf"(?i)^\s*(?:(?:\*\*|__)?(?:{_ANY})(?:\*\*|__)?\s*:(?:\*\*|__)?|<\|(?:{_ANY})\|>|\[/?(?:{_ANY})\]|#+\s*(?:{_ANY})\s*:?(?=\s|$))\s*"
_MARKER = re.compile(MARKER)
LENGTHS = (0, 60, 120, 240, 600)
_MARKERS, _BUCKETS = len(ROLES) + 1, len(LENGTHS) + 1
#: What can be seen of a line: marker and empty line before, length, end (sentence, question or colon, other), capital at its start.
_SHAPE = (2 * _MARKERS, _BUCKETS, 3, 2)
SYMBOLS = int(np.prod(_SHAPE))
#: A state is 2 * role, and 1 more where a turn begins.
STATES = 2 * len(ROLES)
_TIED = 50.0


def marker(line: Column) -> Column:
    """1 + the number of the role whose marker ``line`` begins with, or 0."""
    name = F.lower(F.regexp_extract(F.regexp_extract(line, MARKER, 0), r"[A-Za-z]+", 0))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*NAMES[role]), i + 1).otherwise(out)
    return out


def seen(line: Column, after_empty: Column) -> Column:
    """Number of what is seen of ``line``, from 0 to SYMBOLS - 1."""
    rest = F.regexp_replace(line, MARKER, "")
    length = sum((F.when(F.length(rest) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    end = F.when(rest.rlike(r"[?:]\s*$"), 1).when(rest.rlike(r"[.!)\"']\s*$"), 0).otherwise(2)
    parts = (2 * marker(line) + after_empty.cast("int"), length, end, F.when(rest.rlike(r"^\s*\p{Lu}"), 1).otherwise(0))
    out = F.lit(0)
    for part, size in zip(parts, _SHAPE, strict=True):
        out = out * size + part
    return out.cast("int")


def lines(pieces: DataFrame, *more: str) -> DataFrame:
    """(conv_id, turn, tie, piece, i, empty, line, symbol, *more) for each line of ``pieces`` (conv_id, turn, text) that is not empty.

    turn, tie, piece and i give the order in a conversation; empty is the number of empty lines before the line in its piece.
    """
    t = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *more)
    t = t.select("conv_id", "turn", F.xxhash64("__text").alias("tie"), F.monotonically_increasing_id().alias("piece"), *more, F.posexplode(F.expr("""
      transform(array(split(__text, '\\n')), l -> transform(array(filter(sequence(0, size(l) - 1), i -> l[i] RLIKE r'\\S')), f ->
        transform(filter(sequence(0, size(f) - 1), k -> size(f) > 0), k -> struct(l[f[k]] AS line, if(k = 0, f[0], f[k] - f[k - 1] - 1) AS empty)))[0])[0]""")).alias("i", "l"))
    t = t.select("conv_id", "turn", "tie", "piece", *more, "i", F.col("l.empty").alias("empty"), F.col("l.line").alias("line"))
    return t.withColumn("symbol", seen(F.col("line"), F.col("empty") > 0))


class RoleModel:
    """Log probabilities: initial (states), transition (states x states) and emission (states x symbols)."""

    def __init__(self, initial: np.ndarray, transition: np.ndarray, emission: np.ndarray):
        self.initial, self.transition, self.emission = initial, transition, emission

    @classmethod
    def fit(cls, rows: list[tuple[int, int, bool]]) -> RoleModel:
        """``rows`` in order: (state, symbol, first line of a conversation); state -1 is unknown."""
        role, begins = np.arange(STATES) // 2, np.arange(STATES) % 2 == 1
        # A turn goes on in its own role; whatever comes first begins one.
        initial = np.where(begins, 1.0, 1e-9)
        transition = np.where(begins[None] | (role[:, None] == role[None]), 1.0, 1e-9)
        features = [np.ones((STATES, n)) for n in _SHAPE]
        features[0][:, 0] += np.where(begins, _TIED, 10 * _TIED)
        features[0][~begins, 1] = 0.1  # an empty line inside a turn must be learnt
        for empty in (0, 1):
            features[0][np.flatnonzero(begins), 2 * (role[begins] + 1) + empty] += _TIED
        last = -1
        for state, symbol, first in rows:
            if state >= 0:
                for table, value in zip(features, np.unravel_index(symbol, _SHAPE), strict=True):
                    table[state, value] += 1
                if first:
                    initial[state] += 1
                elif last >= 0:
                    transition[last, state] += 1
            last = state
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        places = np.unravel_index(np.arange(SYMBOLS), _SHAPE)
        return cls(log(initial), log(transition), sum(log(table)[:, at] for table, at in zip(features, places, strict=True)))

    def reduced(self, symbols: list[int], first: bool) -> np.ndarray:
        """Max-plus matrix of a piece of a conversation; all rows are alike where it begins the conversation."""
        e = self.emission[:, symbols].T
        m = (np.tile(self.initial, (STATES, 1)) if first else self.transition) + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.transition[None]).max(axis=1) + row
        return m

    def decoded(self, symbols: list[int], before: int, at_end: int) -> list[int]:
        """Best states of a piece between the state before it (-1: it begins) and the state at its end (-1: any)."""
        e = self.emission[:, symbols].T
        score = (self.initial if before < 0 else self.transition[before]) + e[0]
        back = []
        for row in e[1:]:
            step = score[:, None] + self.transition
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        state = int(score.argmax()) if at_end < 0 else at_end
        path = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            path.append(state)
        return path[::-1]

    def viterbi(self, symbols: list[int]) -> list[int]:
        return self.decoded(symbols, -1, -1) if symbols else []


def seams(matrices: list[np.ndarray]) -> list[int]:
    """The best state at the end of each piece of a conversation, from their matrices in order."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        step = score[:, None] + m
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    states = [int(score.argmax())]
    for pointers in reversed(back):
        states.append(int(pointers[states[-1]]))
    return states[::-1]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> RoleModel:
    """A model of at most ``sample`` lines of ``labelled`` (conv_id, turn, text, role), a row for each turn: those of the conversations of least hash."""
    role = F.lower(F.coalesce(F.col("role"), F.lit("")))
    number = F.lit(-1)
    for i, r in enumerate(ROLES):
        number = F.when(role.isin(r, *NAMES[r]), i).otherwise(number)
    rows = lines(labelled, "role").withColumn("state", F.when(number >= 0, 2 * number + F.when(F.col("i") == 0, 1).otherwise(0)).otherwise(-1))
    rows = rows.orderBy(F.xxhash64("conv_id"), "conv_id", "turn", "tie", "piece", "i").limit(sample).select("conv_id", "state", "symbol").collect()
    told, last = [], object()
    for r in rows:
        told.append((r["state"], r["symbol"], r["conv_id"] != last))
        last = r["conv_id"]
    return RoleModel.fit(told)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, together where their first column is alike."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _edges(groups: Iterator[list[tuple]]) -> Iterator[tuple[bool, list[tuple]]]:
    """(is the first, group) for the first and the last group; one that is both comes once, as the first."""
    last = None
    for i, group in enumerate(groups):
        if i == 0:
            yield True, group
        else:
            last = group
    if last is not None:
        yield False, last


def _chains(edges: list[tuple]) -> list[list[tuple]]:
    """``edges`` (task, is the first, conv_id, ...) in order, those of one conversation in neighbouring tasks together."""
    out: list[list[tuple]] = []
    for i, edge in enumerate(edges):
        # A conversation reaches on where the next edge is the first one of another task and has its conv_id.
        if i and edge[1] and edges[i - 1][2] == edge[2]:
            out[-1].append(edge)
        else:
            out.append([edge])
    return [chain for chain in out if len(chain) > 1]


def recover_turns(pieces: DataFrame, model: RoleModel) -> DataFrame:
    """(conv_id, line_no, turn, role, begins, rendered) for each line of ``pieces`` (conv_id, turn, text) that is not empty.

    line_no and turn count from 0 in each conversation; ``rendered`` in the order of line_no is its canonical form.
    """
    order = ("conv_id", "turn", "tie", "piece", "i")
    rows = checkpointed(lines(pieces).repartitionByRange(*order).sortWithinPartitions(*order))  # keeps what is in which task
    shared = pieces.sparkSession.sparkContext.broadcast(model)
    k = STATES

    def reduce(batches):
        task = TaskContext.get().partitionId()
        out = []
        for first, group in _edges(_by_conversation(batches)):
            symbols = [r[1] for r in group]
            out.append((task, first, group[0][0], len(symbols), symbols[-1], *(shared.value.reduced(symbols, begin).reshape(-1).tolist() for begin in (True, False))))
        if out:
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["task", "first", "conv_id", "n", "symbol", "begin", "inner"])

    edges = rows.select("conv_id", "symbol").transform(in_arrow(reduce, "task int, first boolean, conv_id long, n long, symbol int, begin array<double>, inner array<double>"))
    chains = _chains(sorted((tuple(r) for r in edges.collect()), key=lambda r: (r[0], not r[1])))  # two rows a task at most
    bounds = {}
    for chain in chains:
        ends = seams([np.array(r[5 if i == 0 else 6]).reshape(k, k) for i, r in enumerate(chain)])
        for r, before, end, at in zip(chain, [None, *chain], [-1, *ends], [*ends[:-1], -1], strict=False):
            bounds[r[0], r[1]] = (end, at, before is not None and bare(before[4], end))
    told = pieces.sparkSession.sparkContext.broadcast(bounds)

    def count(batches):
        task = TaskContext.get().partitionId()
        out = [(task, first, sum(s % 2 for s in shared.value.decoded([r[1] for r in group], *told.value[task, first][:2]))) for first, group in _edges(_by_conversation(batches)) if (task, first) in told.value]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.int64()), strict=True)], names=["task", "first", "turns"])

    turns = {}
    if bounds:
        turns = {(r["task"], r["first"]): r["turns"] for r in rows.select("conv_id", "symbol").transform(in_arrow(count, "task int, first boolean, turns long")).collect()}
    starts = {}
    for chain in chains:
        line = turn = 0
        for r in chain:
            starts[r[0], r[1]] = (line, turn)
            line, turn = line + r[3], turn + turns[r[0], r[1]]
    offsets = pieces.sparkSession.sparkContext.broadcast(starts)
    schema = pa.schema([("conv_id", pa.int64()), ("line_no", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("begins", pa.bool_()), ("rendered", pa.string())])

    def render(batches):
        task = TaskContext.get().partitionId()
        groups = _by_conversation(batches)
        group, first, out = next(groups, None), True, []
        while group is not None:
            after = next(groups, None)
            # Only the first and the last conversation of a task can have bounds.
            key = (task, True) if first else (task, False) if after is None else None
            (before, end, alone), (line, turn) = told.value.get(key, (-1, -1, False)), offsets.value.get(key, (0, 0))
            out += rendered(group, shared.value.decoded([r[1] for r in group], before, end), line, turn, end < 0, alone)
            while len(out) >= 2000 or (out and after is None):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out[:2000], strict=True), schema, strict=True)], schema=schema)
                del out[:2000]
            group, first = after, False

    return rows.select("conv_id", "symbol", "empty", "line").transform(in_arrow(render, "conv_id long, line_no long, turn long, role string, begins boolean, rendered string"))


def bare(symbol: int, state: int) -> bool:
    """Whether a line is a marker alone that begins a turn."""
    return state % 2 == 1 and np.unravel_index(symbol, _SHAPE)[1] == 0


def rendered(group: list[tuple], states: list[int], line: int, turn: int, ends: bool, alone: bool = False) -> Iterator[tuple]:
    """The result's rows for the lines ``group`` (conv_id, symbol, empty lines before, line) of one conversation.

    ``line`` and ``turn``: how many come before; ``ends``: whether the conversation ends here; ``alone``: whether
    the line before is a marker alone. The marker of a turn goes, and the form's own tags in the text are broken up.
    """
    for k, ((conv_id, symbol, empty, text), state) in enumerate(zip(group, states, strict=True)):
        role, begins = ROLES[state // 2], state % 2 == 1
        body = _MARKER.sub("", text, count=1).strip() if begins else text
        body = body.replace("<|im_", "< |im_")
        if begins:
            body = ("<|im_end|>\n" if turn else "") + f"<|im_start|>{role}\n{body}"
            turn += 1
        elif not alone:
            body = "\n" * (empty + 1) + body
        alone = bare(symbol, state)
        yield conv_id, line + k, turn - 1, role, begins, body + ("<|im_end|>\n" if ends and k + 1 == len(group) else "")


def format_chats(pieces: DataFrame, model: RoleModel) -> DataFrame:
    """``recover_turns``: a row for each line, whose ``rendered`` in order is the canonical transcript."""
    return recover_turns(pieces, model)


#: How transcripts show a speaker, by style; the last style has an empty line between turns and no marker.
STYLES = ("{}: ", "### {}\n", "<|{}|>\n", "\n")
SPEAKERS = {"system": "System", "user": "User", "assistant": "Assistant"}


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text, role): the turns of ``turns`` as pieces of transcripts, each conversation in one of ``STYLES``.

    A turn of another role than ``SPEAKERS`` has no marker.
    """
    style = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(len(STYLES))), F.lit(len(STYLES) - 1))
    shown = F.lit(STYLES[-1])
    for role, name in SPEAKERS.items():
        for i, form in enumerate(STYLES):
            shown = F.when((F.col("role") == role) & (style == i), F.lit(form.format(name))).otherwise(shown)
    return turns.select("conv_id", "turn", F.concat(shown, F.coalesce("text", F.lit(""))).alias("text"), "role")

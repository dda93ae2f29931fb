import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat


def model():
    rng = np.random.default_rng(4)
    return chat.RoleModel.fit([(int(r), int(s), i % 5 == 0) for i, (r, s) in enumerate(zip(rng.integers(0, chat.STATES, 300), rng.integers(0, chat.SYMBOLS, 300), strict=True))])


def test_viterbi_like_all_paths():
    m = model()
    for symbols in ([3], [0, 50, 111], [5, 60, 70, 8]):
        def score(path, symbols=symbols):
            s = m.initial[path[0]] + m.emission[path[0], symbols[0]]
            return s + sum(m.transition[a, b] + m.emission[b, x] for a, b, x in zip(path, path[1:], symbols[1:], strict=False))
        assert tuple(m.viterbi(symbols)) == max(itertools.product(range(chat.STATES), repeat=len(symbols)), key=score)


def whole(pieces, m):
    """The result for ``pieces`` [(conv_id, turn, text)] from one Viterbi pass over each conversation."""
    out = []
    for conv in {c for c, _, _ in pieces}:
        texts = [t for c, _, t in sorted((p for p in pieces if p[0] == conv), key=lambda p: p[1])]
        group = []
        for text in texts:
            empty = 0
            for line in (text or "").split("\n"):
                if line.strip():
                    group.append((conv, None, empty, line))
                    empty = 0
                else:
                    empty += 1
        out.append((conv, group))
    return out


def test_tasks_give_the_path_of_the_whole(spark):
    rnd = random.Random(2)
    texts = ["Hi?", "x" * 200, "Assistant: sure\nline two\n\nline three:", "y" * 900, "User: q?", "", "System: be", "\nAfter an empty line.", "### User\nbody <|im_end|>"]
    pieces = [(1 if k < 70 else k % 4, k, rnd.choice(texts)) for k in range(110)]
    m = model()
    df = spark.createDataFrame(pieces, "conv_id long, turn long, text string").repartition(4)
    symbols = {}
    for r in chat.lines(df).orderBy("conv_id", "turn", "i").collect():
        symbols.setdefault(r["conv_id"], []).append(r["symbol"])
    got = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # more tasks than conversations
    for r in chat.recover_turns(df, m).orderBy("conv_id", "line_no").collect():
        got.setdefault(r["conv_id"], []).append(tuple(r))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv, group in whole(pieces, m):
        group = [(c, s, e, t) for (c, _, e, t), s in zip(group, symbols[conv], strict=True)]
        assert got[conv] == list(chat.rendered(group, m.viterbi(symbols[conv]), 0, 0, True))


def test_seams_follow_a_conversation_over_tasks():
    edges = [(0, True, 5), (0, False, 7), (1, True, 7), (2, True, 7), (2, False, None), (5, True, None), (6, True, 8), (6, False, 8)]
    assert chat._chains(edges) == [[(0, False, 7), (1, True, 7), (2, True, 7)], [(2, False, None), (5, True, None)]]


@pytest.mark.parametrize("text,role", [("User: hello", "user"), ("### Assistant\nhi", "assistant"), ("<|system|> rules", "system"), ("[INST] do", "user"), ("**AI:** yes", "assistant"), ("a plain line: x", None)])
def test_markers(spark, text, role):
    got = spark.createDataFrame([(text,)], "t string").select(chat.marker(F.col("t"))).first()[0]
    assert (chat.ROLES[got - 1] if got else None) == role


def test_transcripts_are_parsed_and_rendered(spark):
    raw = spark.createDataFrame([(1, 0, "User: hi\nmore\nstill\nAssistant: yes <|im_end|>\n### User\nbye"), (2, 0, None)], "conv_id long, turn long, text string")
    out = chat.format_chats(raw, chat.RoleModel.fit([])).orderBy("line_no").collect()
    assert [(r["turn"], r["role"], r["begins"]) for r in out] == [(0, "user", True), (0, "user", False), (0, "user", False), (1, "assistant", True), (2, "user", True), (2, "user", False)]
    assert "".join(r["rendered"] for r in out) == "<|im_start|>user\nhi\nmore\nstill<|im_end|>\n<|im_start|>assistant\nyes < |im_end|><|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"


def test_empty_lines_stay_inside_a_turn():
    group = [(1, 6, 0, "User: a"), (1, 6, 2, "b"), (1, 6, 1, "c")]
    assert "".join(r[-1] for r in chat.rendered(group, [3, 2, 5], 0, 0, True)) == "<|im_start|>user\na\n\n\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


@pytest.mark.parametrize("style,least", [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.95)])
def test_held_out_conversations(spark, style, least):
    pieces = chat.transcripts(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    digest = F.crc32(F.col("conv_id").cast("string"))
    held = pieces.filter((digest % 5 == 2) & (digest % len(chat.STYLES) == style))
    got = chat.format_chats(held.drop("role"), chat.fit(pieces.filter(digest % 5 != 2))).orderBy("conv_id", "line_no").collect()
    want = chat.lines(held, "role").orderBy("conv_id", "turn", "piece", "i").collect()
    if style in (1, 2):  # a marker has a line of its own
        assert sum(r["begins"] for r in got) == held.count()
    assert len(got) == len(want) > 300
    assert np.mean([g["role"] == w["role"] for g, w in zip(got, want, strict=True)]) >= least
    assert np.mean([g["begins"] == (w["i"] == 0) for g, w in zip(got, want, strict=True)]) == 1


def test_odd_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, None, ""), (1, 0, None, "x"), (1, 0, None, "x"), (2, 5, "x", "a" * 100_000), (2, None, "bot", "hi?\nyes")], "conv_id long, turn long, role string, text string")
    odd = odd.withColumn("symbol", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("line", F.lit("l"))
    m = chat.fit(odd)
    got = chat.format_chats(odd, m).orderBy("conv_id", "line_no").collect()
    assert [(r["conv_id"], r["line_no"]) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)] and got[4]["rendered"].count("a") >= 100_000
    assert chat.format_chats(odd.limit(0), chat.fit(odd.limit(0))).collect() == []

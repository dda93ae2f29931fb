import random

from millrace.llm import substring_dedup as sd

PASSAGE = "Passage one begins here with some words. It goes on for a good while and then stops. " + " ".join(f"Sentence {k} of the shared passage holds seven more plain words." for k in range(6))


def clean(i):
    return " ".join(f"Own sentence {k} of text {i} says thing{i}x{k}." for k in range(12))


def rows():
    return [(1, clean(1) + " and then\n" + PASSAGE + " " + clean(11)), (2, clean(2)), (3, clean(3) + " goes on with " + PASSAGE + " then more. " + clean(33)), (4, PASSAGE), (5, clean(5)), (None, PASSAGE), (7, None), (8, ""), (9, PASSAGE + "\n" + PASSAGE)]


def test_passages_are_cut_from_all_but_the_first(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in sd.find_repeats(df).collect()}
    assert set(got) == {3, 4, None, 9} and all(r["first_docs"] == [1] for r in got.values())
    texts = dict(rows())
    for i, r in got.items():
        cut = "".join(texts[i][s["start"] : s["end"]] for s in r["spans"])
        assert r["removed_chars"] == len(cut) >= 0.9 * len(PASSAGE) * (2 if i == 9 else 1)
        assert not set(cut) & set("x")
    kept = {r["doc_id"]: r["text"] for r in sd.drop_repeats(df).collect()}
    assert kept[1] == texts[1] and kept[2] == texts[2] and kept[7] is None and "Sentence 3" not in kept[3] and clean(33) in kept[3] and clean(3)[:-1] in kept[3]


def test_offsets_are_code_points_and_windows_cover_min_words():
    text = "🙂 é first unit has words. Second unit has some more words here.\nThird line."
    for start, end, _ in sd.windows(text, 5):
        assert len(text[start:end].split()) >= 5 and text[start] != " " and text[end - 1] != " "
    assert sd.windows("", 5) == [] and sd.windows("a b c", 5) == []


def test_same_passage_gives_same_digests_wherever_it_stands():
    a, b = sd.windows("bare words before " + PASSAGE), sd.windows("Other.\n" + PASSAGE + " tail")
    assert len({d for *_, d in a} & {d for *_, d in b}) >= 5


def test_repeats_within_one_text_keep_the_first(spark):
    line = "this very line is repeated again and again and has well over twenty words in it so that it makes up a window alone"
    df = spark.createDataFrame([(1, "\n".join([line] * 5))], "doc_id long, text string")
    r = sd.find_repeats(df).first()
    assert r["spans"][0]["start"] >= len(line) and r["first_docs"] == [1]


def test_spans():
    assert sd.removed_spans([(0, 10, False), (5, 20, False), (30, 40, True)]) == [(0, 20)]
    assert sd.removed_spans([(0, 30, False), (10, 20, True)]) == [(0, 10), (20, 30)]
    assert sd.removed_spans([(0, 10, True)]) == []


def test_odd_and_empty_tables(odd, none):
    got = {r["doc_id"] for r in sd.find_repeats(odd).collect()}
    assert {8, 9} <= got and not got & {1, 2, 3, 10}
    assert sd.find_repeats(none).collect() == [] and sd.drop_repeats(none).collect() == []
    assert sd.drop_repeats(odd).columns == odd.columns and sd.drop_repeats(odd).count() == odd.count()


def brute_lines(rows, least):
    """Spans by (doc_id, text) from plain dictionaries of lines and of paragraphs of several lines."""
    units, first = [], {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        at, paragraph, found = 0, [], []
        for line in [*text.split("\n"), ""]:
            if line.split():
                start = at + len(line) - len(line.lstrip())
                paragraph.append((start, at + len(line.rstrip()), line.lower().split()))
                found.append(paragraph[-1])
            else:
                if len(paragraph) > 1:
                    found.append((paragraph[0][0], paragraph[-1][1], [w for x in paragraph for w in x[2]]))
                paragraph = []
            at += len(line) + 1
        found = [f for f in found if len(f[2]) >= least]
        for start, end, words in sorted(found):
            units.append((doc_id, text, start, end, first.setdefault(tuple(words), (doc_id, text, start)) == (doc_id, text, start)))
    out = {}
    for doc_id, text, *_ in units:
        spans = sd.removed_spans([(s, e, False) for i, t, s, e, stays in units if (i, t) == (doc_id, text) and not stays])
        if spans:
            out[doc_id, text] = spans
    return out


def test_lines_and_paragraphs_like_brute_force(spark):
    rnd = random.Random(6)
    pool = ["One line here", " another  LINE", "x", "", "last line of all é", "one line HERE", "y z"]
    rows = [(k if k % 7 else None, f"text {k}\n" + "\n".join(rnd.choices(pool, k=rnd.randint(0, 8)))) for k in range(1, 40)]
    got = sd._spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 10**6, 5).collect()
    texts = {(i, sd._text_hash(t)): t for i, t in rows}
    # Of rows with a null doc_id the one of the least hash comes first.
    want = brute_lines(sorted(rows, key=lambda r: sd._text_hash(r[1])), 2)
    assert {(r["doc_id"], texts[r["doc_id"], r["key"]]): [tuple(s) for s in r["spans"]] for r in got} == want and len(want) > 10


def test_each_run_of_shared_words_is_found_without_punctuation(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    rows, runs = [], {}
    for k in range(30):
        run = " ".join(word() for _ in range(sd.WINDOW + sd.SPAN + sd.SLACK))
        for i in (2 * k, 2 * k + 1):
            before = " ".join(word() for _ in range(rnd.randint(0, 40)))
            rows.append((i, f"{before} {run} " + " ".join(word() for _ in range(rnd.randint(0, 40)))))
            runs[i] = (len(before) + 1, len(before) + 1 + len(run))
    got = {r["doc_id"]: r for r in sd.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(1, 60, 2))
    for i, r in got.items():
        assert r["first_docs"] == [i - 1] and all(runs[i][0] <= s["start"] < s["end"] <= runs[i][1] for s in r["spans"])


def test_texts_of_one_doc_id_are_documents_each(spark):
    rows = [(7, PASSAGE), (7, clean(1)), (None, clean(2)), (None, PASSAGE + " " + clean(3)), (7, clean(1)), (9, clean(1)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in sd.drop_repeats(df).collect())
    assert len(kept) == 7 and kept.count(("7", clean(1))) == 2 and ("7", PASSAGE) in kept and ("None", clean(2)) in kept
    assert ("9", "") in kept and any(i == "None" and t.endswith(clean(3)) and "Sentence 3" not in t for i, t in kept)

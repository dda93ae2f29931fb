import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plan_places_every_piece_once_without_gaps(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 40), max_size=30))
    runs = packing.plan(counts, capacity)
    filled = defaultdict(list)
    for length, total in counts.items():
        own = [r for r in runs.tolist() if r[0] == length]
        bounds = [r[1] for r in own] + [total]
        assert bounds == sorted(bounds) and bounds[0] == 0
        for (_, first, _, each, sequence, offset), end in zip(own, bounds[1:], strict=True):
            for i in range(end - first):
                filled[sequence + i // each].append((offset + i % each * length, length))
    assert sorted(filled) == list(range(len(filled)))
    for placed in filled.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in placed) <= 2


def test_plan_pairs_well():
    assert len({r[4] for r in packing.plan({60: 1, 40: 1, 55: 1, 45: 1}, 100).tolist()}) == 2
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_chunks_encode_as_the_library_does():
    rnd = random.Random(3)
    letters = list(" \t\n\x1c\x85\xa0​　ab'stre1²ßΣσİ中🙂́.,-_") + ["<|endoftext|>", "<|STARTOFTEXT|>", "'ll", "the ", "İ", "Å"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + ["", "x" * 3000]
    library, own = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH, memo=50)
    got = [x for i in range(0, len(texts), 40) for x in own.encode(texts[i : i + 40])]
    for text, raw, ref in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == ref.ids, repr(text)


def test_packing_like_the_contract(docs, odd, none):
    library = Tokenizer.from_file(PATH)
    for table in (docs, odd.filter("doc_id != 6")):
        rows = packing.pack(table, PATH, 512).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        for doc in table.collect():
            ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            pieces = sorted(by_doc[doc["doc_id"]], key=lambda r: r["piece"])
            assert [p["start"] for p in pieces] == list(range(0, len(ids), 512)) and sum(p["length"] for p in pieces) == len(ids)
            assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)
        for placed in by_sequence.values():
            at = 0
            for r in sorted(placed, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 512
        assert len(by_sequence) <= 1.1 * sum(r["length"] for r in rows) / 512 + 1
    assert packing.pack(odd, PATH).count() >= odd.count() and packing.pack(none, PATH).collect() == []


def test_each_code_point_is_encoded_as_the_library_does():
    library, own = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    points = [*range(1, 0xD800), *range(0xE000, 0x34000), *range(0x34000, 0x110000, 4099)]
    for context in ("a{0}b 1{0}'s", "x{0}. {0}, ${0}a É{0}'ll.{0}2 {0}"):
        for i in range(0, len(points), 4000):
            texts = [context.format(chr(c)) for c in points[i : i + 4000]]
            for text, raw, ref in zip(texts, own.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                assert np.frombuffer(raw, dtype="<u4").tolist() == ref.ids, repr(text)

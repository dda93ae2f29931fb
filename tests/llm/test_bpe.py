import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_maps_its_words_and_no_others(entries, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    words = [*entries, *others]
    for word, place in zip(words, lexicon.places(words).tolist(), strict=True):
        assert (place >= 0) == (word in entries)
        if place >= 0:
            assert lexicon.ids_of(place) == entries[word]
    assert sorted(lexicon.places(list(entries)).tolist()) == list(range(len(entries)))


def test_suffixes_are_shared():
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w.encode(): [1] for w in ("nation", "station", "ration", "relation")}))
    assert lexicon.final.size < sum(map(len, ("nation", "station", "ration", "relation"))) - 8


def test_ids_and_bytes_are_the_librarys():
    rnd = random.Random(5)
    letters = list(" \t\n\x1c\x85\xa0​　ab'stre1²ßİ中🙂́.,-_") + ["<|endoftext|>", "'ll", " the", "12"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + ["", "ab" * 3000, " " * 99]
    library = Tokenizer.from_file(PATH)
    for lexicon in (b"", bpe.lexicon_for(["the", "ab", "stress", "12"], PATH)):
        encoder = bpe.Encoder(PATH, bpe.Lexicon(lexicon or bpe.compile_lexicon({})), memo=50)
        for text, row in zip(texts, encoder.encode(texts), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert ",".join(x[1] for x in row) == ",".join(map(str, ids)), repr(text)
            assert b"".join(x[2] for x in row).decode() == library.decode(ids, skip_special_tokens=False)


def test_query_like_the_library(docs, odd, none):
    library = Tokenizer.from_file(PATH)
    for table in (docs, odd.filter("doc_id != 6")):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        rows = bpe.digests(table, PATH).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.digests(odd, PATH).count() == odd.count() and bpe.digests(none, PATH).collect() == []


def test_each_code_point_is_cut_as_the_library_cuts_it():
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(PATH, bpe.Lexicon(bpe.lexicon_for(["the", "ab"], PATH)))
    points = [*range(1, 0xD800), *range(0xE000, 0x34000), *range(0x34000, 0x110000, 4099)]
    for context in ("a{0}b 1{0}'s", "{0}'ll.{0}2  {0} {0}'{0}s\t{0}"):
        for i in range(0, len(points), 4000):
            texts = [context.format(chr(c)) for c in points[i : i + 4000]]
            for text, row, ref in zip(texts, encoder.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                assert row[0][1] == ",".join(map(str, ref.ids)), repr(text)


def test_words_merged_together_are_those_merged_alone():
    rnd, merger = random.Random(8), bpe.Merger(PATH)
    words = [bytes(rnd.choices(b"etaoin shrdlu\xc3\xa9", k=rnd.randint(1, 130))) for _ in range(3000)] + [b"aaaaaaa", b"a"]
    ids, sizes = merger.merge_all(words)
    stops = sizes.cumsum().tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *stops], stops, strict=False)] == [merger.merge(w) for w in words]

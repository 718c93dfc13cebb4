import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import bpe, tokenpack, wordtable
from lodestrata.llm.queries import tokenizer_file

BYTE, WORD, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
ODD = [
    "a  b", "  x", "x  ", "a\n\nb", "a\n b\t\tc", "don't 's", "İstanbul ΑΣ Σ", "a b　c", "\x1c\x1d a\x1cb", "<|endoftext|>x", "x<|startoftext|> y", "é ́a", "日本語 テキスト🎉🎉", "   ", "\n", "", None,
    "\r\n\r\nabc", "a᠎b", "﻿x y", "12345 1 22", "a\x85b", "we'll  'll ''''", "ﬁ Å K", "word " * 5000,
]


def whole(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abXé́ 　.1İΣ日🎉"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_tables_equal_the_library(text):
    for path, kind, ranks in ((BYTE, "byte", None), (BYTE, "byte", RANKS), (WORD, "word", None)):
        assert np.frombuffer(wordtable.word_table(path, kind, ranks).encode(text), "<u4").tolist() == whole(wordtable.word_table(path, kind, ranks).tokenizer, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abXsÉéßÿ×.,<|>19"), st.characters(max_codepoint=0x17F)), max_size=30) | st.sampled_from(ODD[:-1]), max_size=4))
def test_texts_encoded_together_equal_the_library(texts):
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        table = wordtable.word_table(path, kind)
        assert [np.frombuffer(x, "<u4").tolist() for x in table.encode_many([*texts, None])] == [whole(table.tokenizer, t) for t in [*texts, None]]


def test_new_words_of_several_texts_are_learnt_together():
    t, parts = wordtable.WordTable(WORD, "word", limit=40), []
    for name in ("_learn_single", "_learn"):
        own = getattr(t, name)
        setattr(t, name, lambda words, *more, own=own: parts.append(len(words)) or own(words, *more))
    for texts in (["a b é", "c d", "b e"], ["a Ab", "f"], [f"w{i}" for i in range(30)], ["b a"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_many(texts)] == [whole(t.tokenizer, x) for x in texts]
    assert parts[:3] == [5, 1, 0] and len(parts) == 12 and len(t.table) + len(t.old) <= 60


def test_full_table_keeps_frequent_words():
    t = wordtable.WordTable(BYTE, "byte", limit=8)
    for text in ("a b c d e", "f g", "a b c d e", "a h", "a i j", "a k l m", "a b"):
        assert np.frombuffer(t.encode(text), "<u4").tolist() == whole(t.tokenizer, text)
    assert "a" in t.table and len(t.table) + len(t.old) < 14


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_round_trip_equals_the_library(spark, ranks):
    docs = [(i, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "a b", 1, "x"), (0, ODD[0], 1, "x")]
    df, tok = spark.createDataFrame(docs, "doc_id long, text string, ids int, decoded string"), Tokenizer.from_file(BYTE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(str(i), len(ids := whole(tok, t)), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) for i, t, *_ in docs]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, BYTE, ranks=ranks).collect()) == sorted(want)
    assert bpe.round_trip(df.limit(0), BYTE).count() == 0 and bpe.encode_documents(df, BYTE).columns == df.columns


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([([50256, 64],), ([],), (None,), ([-1, 64, 99999999],), ([160],)], "ids array<int>")
    got = [r.t for r in df.select(bpe.decode(df.ids, BYTE).alias("t")).collect()]
    tok = Tokenizer.from_file(BYTE)
    assert got == [tok.decode([50256, 64], skip_special_tokens=False), "", None, tok.decode([64]), tok.decode([160])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=600), st.integers(1, 100), st.data())
def test_segments_keep_every_id(ids, percentile, data):
    s = tokenpack.Segment(tokenpack.pack_segment([None, 7, -3], [len(ids), 0, 0], np.array(ids, "<u4"), percentile))
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert s.ids().tolist() == ids and s.ids(lo, hi).tolist() == ids[lo:hi] and s.doc_ids == [None, 7, -3]


def test_outliers_go_to_the_exception_list():
    ids = np.full(128, 1000, "<u4")
    ids[5] = 50_000
    s = tokenpack.Segment(tokenpack.pack_segment([1], [128], ids))
    assert s.width.tolist() == [0] and s.place.tolist() == [5] and (s.ids() == ids).all()
    with pytest.raises(ValueError):
        tokenpack.Segment(b"x" * 100)


def test_files_read_back(spark, tmp_path):
    docs = [(i * 3 % 25, t, "p") for i, t in enumerate(ODD)] + [(None, "null id", "p"), (4, "again", "p"), (4, "again", "p")]
    df, tok = spark.createDataFrame(docs, "doc_id long, text string, part string").repartition(5), Tokenizer.from_file(WORD)
    tokenpack.write_tokens(df, str(tmp_path / "t"), WORD, segment_ids=50)
    got = tokenpack.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(got) == len(docs) and [r.doc_id for r in got] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i))
    own = {}
    for i, t, _ in docs:
        own.setdefault(i, []).append(whole(tok, t) + [1])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in own[r.doc_id] and bytes(r.ids_le) == np.array(r.ids, "<u4").tobytes()
        at += r.n_tokens
    digests = tokenpack.token_digests(df, WORD).collect()
    assert {(r.doc_id, r.ids_crc32) for r in digests} == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, xs in own.items() for x in xs}
    assert tokenpack.token_digests(df.limit(0), WORD).count() == 0


def test_registered_query_equals_the_library_on_every_text(spark):
    from lodestrata.llm import queries

    at, tok = "/root/testdata/sf0.001", Tokenizer.from_file(BYTE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {r.doc_id: (len(ids := whole(tok, r.text)), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, at).collect()} == want

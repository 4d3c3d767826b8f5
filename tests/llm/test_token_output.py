import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import simple8b, token_output, tokens
from pixelloom.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, n_tokens string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_round_trip(values, times):
    ids = np.array(values * times, np.uint64)
    words, offsets, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, escapes, len(ids)) == ids).all()
    docs, lengths, back = simple8b.unpack_segment(simple8b.pack_segment([None, 7], [0, len(ids)], ids))
    assert docs == [None, 7] and lengths.tolist() == [0, len(ids)] and (back == ids).all()


def test_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * simple8b.BLOCK + 5).astype(np.uint64)
    ids[simple8b.BLOCK + 3] = 2**63
    words, offsets, escapes = simple8b.encode(ids)
    a, b = int(offsets[1]), int(offsets[2])
    own = escapes[(escapes >= a) & (escapes < b)] - np.uint64(a)
    got = simple8b.decode(words[a:b], offsets[1:3] - offsets[1], own, simple8b.BLOCK)
    assert (got == ids[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()
    assert len(words) < len(ids) / 2


@pytest.mark.parametrize("text", ["", "Hello, World. it's a test.", "a\x1cb c.", "x<|endoftext|>y z", "Öl Σας ΣΑΣ. İi ... é.", "don't. 12,5. 3.\n\tq,"])
def test_words_give_the_ids_of_the_text(text):
    enc = Encoder("word_bpe_49k.json")
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    number, ids = enc.encode(pa.array([text, None, text]))
    assert ids.tolist() == want * 2 and number.tolist() == [len(want), 0, len(want)] == enc.count(pa.array([text, None, text])).tolist()


#: Letters, marks and spaces on which lower-casing, normal forms, splitting and special tokens depend.
ODD = "abcxyzABCXYZ.,;!?'\"<|>()-_*%$ 019éÉàçßÿÜñœŒİıſK\u00c5ΣσςµªºǺ̇\u00a0\u2003\u0085\u200b\x1c\x1fǅ中ё٣½\n"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts(name):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list(ODD), int(rng.integers(0, 15)))) for _ in range(8000)] + ["İ.", "cİ, x", "Tokatlİ.", "İSTANBULİ.", "<|ENDOFTEXT|>", "a<|endoftext|>b", "'LL", "x" * 200]
    enc = Encoder(name)
    number, ids = enc.encode(pa.array(texts))
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])] == want


def test_plain_words_are_merged_here():
    enc = Encoder("word_bpe_49k.json")
    assert enc.merges is not None
    words = pa.array(["tionthsh", "banana", "été!!", "(x)", "a-b"])
    assert pc.match_substring_regex(words, tokens._PLAIN).to_pylist() == [True, True, True, True, False]


def brute(rows):
    enc = Encoder("word_bpe_49k.json").tokenizer
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 50)
    rows = [(k, f"word{k} and. " * (k % 7) * 9, "x") for k in range(60)] + [(None, "a b", "x"), (5, "tie", "x"), (5, "tie", "x"), (77, None, None), (78, "", "x"), (79, "long text, " * 20_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    token_output.write_token_ids(df, str(tmp_path / "t"), parts=4)
    got = [tuple(r) for r in token_output.read_documents(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute([r[:2] for r in rows])


def test_empty_table(spark, tmp_path):
    token_output.write_token_ids(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"))
    assert token_output.read_documents(spark, str(tmp_path / "t")).collect() == []

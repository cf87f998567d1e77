import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavehold.llm import bpe
from wavehold.llm.common import fresh_path
from wavehold.llm.packing import _WordEncoder, bits_for, pack, read_documents, read_ids, unpack, write_blocks
from wavehold.llm.queries import TOKENIZERS

BYTE, WORD = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"
ATOMS = [*"ab cdé ñß\n\t  's're'll 12 ,.; 日本\x1c\x85\xa0　\U0001f642\r\nÀΣAZ_ªʰ\0", "<|endoftext|>", "<|ENDOFTEXT|>", " the", "'s", "  ", "hello", "%%% ", "nation"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(BYTE), Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=50).map("".join))
def test_bpe_equals_library(coder, text):
    own, library = coder
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0].tolist() == ids
    assert own.merges.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decoding_any_ids_equals_library(coder, ids):
    assert coder[0].merges.decode(ids) == coder[1].decode(ids, skip_special_tokens=False)


def test_single_and_batched_trees_agree(coder):
    random.seed(4)
    words = list({"".join(random.choices("abcdehinorst", k=random.randint(1, 70))).encode() for _ in range(400)})
    merges = coder[0].merges
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.many(words)] == [merges.one(w) for w in words]


def test_memory_keeps_results(coder):
    small = bpe.Encoder(BYTE, limit=5)
    texts = ["one two three four five six seven", "two nine ten", "one two eleven twelve thirteen", "four five six"] * 3
    for t in texts:
        assert small.encode([t])[0].tolist() == coder[1].encode(t, add_special_tokens=False).ids


def test_bpe_on_odd_rows(spark, odd, none):
    library = Tokenizer.from_file(BYTE)
    got = bpe.encode_decode(odd, BYTE)
    assert set(got.columns) == set(odd.columns)  # ids and decoded are replaced
    for r in got.select("text", "ids", "decoded").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(none, BYTE).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [31373, None, 99999, -1])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(lists, BYTE).collect()} == {1: "", 2: "", 3: "hello"}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.integers(0, 1 << 30))
def test_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
    data = pack(ids, bits, step=64)
    assert len(data) == -(-n * bits // 8)
    a, b = sorted(np.random.default_rng(seed + 1).integers(0, n + 1, 2).tolist())
    assert (unpack(data, bits, a, b) == ids[a:b]).all() and (unpack(data, bits, 0, n) == ids).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        pack(np.array([8]), 3)


def test_words_equal_library():
    random.seed(5)
    library, own = Tokenizer.from_file(WORD), _WordEncoder(WORD, 50)
    texts = ["".join(random.choices(ATOMS, k=random.randint(0, 40))) for _ in range(1500)]
    for k in range(0, len(texts), 100):
        got = own.encode([t.encode() for t in texts[k : k + 100]])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts[k : k + 100], add_special_tokens=False)]


def test_words_that_fit_are_encoded_once():
    own, learned = _WordEncoder(WORD, 100), []
    learn = own.learn
    own.learn = lambda parts: (learned.extend(parts), learn(parts))
    batches = [" ".join(f"{a}{b}" for b in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st")) for a in "abcdefghijklmnopqr"]
    for _ in range(4):
        for k in range(0, 18, 6):
            own.encode([t.encode() for t in batches[k : k + 6]])
    assert len(learned) == 180


@pytest.mark.parametrize("bits,parts", [(49_408, 3), (1 << 19, 1)])
def test_blocks_equal_library(spark, odd, bits, parts):
    at, library = fresh_path(spark, "blocks"), Tokenizer.from_file(WORD)
    write_blocks(odd, at, WORD, bits, block_ids=40, parts=parts)
    rows = odd.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    got = sorted(read_documents(spark, at).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert any(len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    assert read_ids(spark, at, 7).tolist() == want[7][0] and read_ids(spark, at, 99) is None


def test_no_documents_no_blocks(spark, none):
    at = fresh_path(spark, "blocks")
    write_blocks(none, at, WORD, 49_408)
    assert read_documents(spark, at).count() == 0

"""Token counts, token files, BPE: against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plumbline.llm import _units, bpe, token_counts, token_files
from plumbline.llm._units import UnitEncoder, encoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "a", "Hello, world", "  two  blanks ", "a\n\nb\n\n\nc\t d\r\n", "<|endoftext|> x<|startoftext|>y",
         "Ünïcödé 日本語 　  x", "it's we'll 's", "\x1cab\x1dc \x00", "aaaaaaaaaa bababababab " * 40,
         "A" * 20000, "word " * 5000, "Hello, world", "ΑΣ Σ İ ﬁ"]
ROWS = list(enumerate(TEXTS)) + [(None, "no id"), (3, "a")]


def library(path):
    return Tokenizer.from_file(path)


def test_counts(spark, documents, files):
    docs = documents(ROWS)
    cache = token_counts.new_cache(files())
    got = token_counts.count_tokens(docs, BYTE, cache).collect()
    lib = library(BYTE)
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS if i is not None)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got if r.doc_id is not None) == want
    assert len(got) == len(ROWS) and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    # Each distinct text is stored once, and a second run adds nothing.
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in ROWS})
    again = token_counts.count_tokens(docs, BYTE, cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and spark.read.parquet(cache).count() == stored
    # Another tokenizer has entries of its own.
    other = token_counts.count_tokens(docs, PIECE, cache).collect()
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert {r.doc_id: r.n_tokens for r in other if r.doc_id == 4} == {4: len(piece.encode("Hello, world"))}
    assert spark.read.parquet(cache).count() == 2 * stored


def test_counts_of_nothing(documents, files):
    assert token_counts.count_tokens(documents([]), BYTE, token_counts.new_cache(files())).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x1c　\xa0aé1'!s.Σ́<|", max_size=30), max_size=4))
def test_units_give_the_librarys_ids(texts):
    own = encoder(BYTE)
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in own.encode(texts)] == want
    assert own.counts(texts).tolist() == list(map(len, want))


def test_a_word_is_asked_for_once_whatever_signs_follow(monkeypatch):
    own, asked = UnitEncoder(BYTE), []
    ask = own._library
    monkeypatch.setattr(own, "_library", lambda texts: asked.extend(texts) or ask(texts))
    texts = ["Of zyxwvut, zyxwvut. zyxwvut! zyxwvut", "No zyxwvut; ézyx... ézyx\nOf zyxwvut's (zyxwvut)"]
    lib = library(BYTE)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in own.encode(texts)] == want
    words = " ".join(asked).split()
    assert words.count("zyxwvut") == words.count("ézyx") == 1
    assert not {"zyxwvut,", "zyxwvut.", "zyxwvut!", "zyxwvut;", "ézyx..."} & set(words)


def test_units_over_slices_and_generations(monkeypatch):
    monkeypatch.setattr(_units, "MAX_UNITS", 12)
    monkeypatch.setattr(_units, "_SLICE", 40)
    words = ["of", "of,", "Of.", "zu", "zu's", "'s,", "ñé!", "日本。", "日本.", "\x1cab", "\x1c", "x1.", "?!", "2,", "ªº:"]
    blanks = [" ", "\n", " ", "\n\n", "  ", "\t", " ", "\u3000"]
    texts = ["".join(words[(k * k + j * (k + 3)) % len(words)] + blanks[(k + j * j) % (3 if k % 2 else len(blanks))]
                     for j in range(k % 9)).strip(" " if k % 3 else "") + "z" * (k % 2) for k in range(120)]
    texts[7] += "<|endoftext|>"
    own, lib = UnitEncoder(BYTE), library(BYTE)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in own.encode(texts)] == want
    assert own.old is not own.young
    assert own.counts(texts).tolist() == list(map(len, want))


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), min_size=1, max_size=6))
def test_packing(documents_of_values):
    sizes = np.array(list(map(len, documents_of_values)), np.int64)
    values = np.array([v for d in documents_of_values for v in d], np.uint32)
    control, data = token_files.pack(values, sizes)
    assert len(control) == sum(-(-s // 4) for s in sizes)
    assert (token_files.unpack(control, data, sizes) == values).all()


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_token_files(spark, documents, files, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    path = f"{files()}/tokens"
    token_files.write_files(documents(ROWS), BYTE, path)
    lib = library(BYTE)
    got = token_files.read_files(spark, path).collect()
    assert len(got) == len(ROWS)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in ROWS if i not in (None, 3)}
    for r in got:
        if r.doc_id in want:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_digests(spark, path).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}


def test_token_files_of_nothing(spark, documents, files):
    path = f"{files()}/none"
    token_files.write_files(documents([]), BYTE, path)
    assert token_files.read_files(spark, path).count() == 0


def test_bpe(documents):
    lib = library(WORD)
    want = sorted(
        (str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for i, t in ROWS for ids in [lib.encode(t or "", add_special_tokens=False).ids])
    got = bpe.digests(documents(ROWS), WORD).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    encoded = bpe.encode(documents(ROWS), WORD)
    assert {r.doc_id: r.ids for r in encoded.collect()}[4] == lib.encode("Hello, world").ids
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, WORD).collect()}
    assert texts[4] == lib.decode(lib.encode("Hello, world").ids, skip_special_tokens=False)
    assert bpe.digests(documents([]), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcABC 'sé́Σ12!\t\x1c<|", max_size=30), max_size=4))
def test_pair_index_gives_the_librarys_ids(texts):
    own = bpe.text_encoder(WORD)
    lib = own.pairs.tokenizer
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    got = list(own.encode(texts))
    assert [(i, n) for i, _, n in got] == [(" ".join(map(str, ids)), len(ids)) for ids in want]
    assert [d for _, d, _ in got] == [lib.decode(ids, skip_special_tokens=False) for ids in want]


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.PairIndexEncoder(BYTE)

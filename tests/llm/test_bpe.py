import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import SMALL, docs  # noqa: F401
from tokenizers import Tokenizer

from orderlens.llm import bpe
from orderlens.llm import chartext as ct
from orderlens.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    fuzz = random.Random(2)
    signs = "ab's'tT'll 've're\n\n\t  d é中1２Ⅷ.,!! 　\x1c\x85😀é<|endoftext|>Ᲊ\U00016130"
    made = ["".join(fuzz.choice(signs) for _ in range(fuzz.randint(0, 60))) for _ in range(500)]
    made += ["", " ", "\n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 4000 + "  " + "theother" * 300]
    return made + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()


def test_ids_and_text_are_the_librarys(texts, library):
    encoder, vocabulary = bpe.segment_tree_encoder(VOCABULARY)
    for text, ids, want in zip(texts, encoder.texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
        assert bpe.decode(ids, vocabulary) == library.decode(want.ids, skip_special_tokens=False) == text


def test_cut_anywhere_safe(texts, library, monkeypatch):
    monkeypatch.setattr(bpe.safe_chunks, "__defaults__", (7,))
    encoder, _ = bpe.segment_tree_encoder(VOCABULARY)
    for text, ids in zip(texts[:300], encoder.texts(texts[:300]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_of_trees_equal_single_trees():
    _, vocabulary = bpe.segment_tree_encoder(VOCABULARY)
    words = [w.encode() for w in "the theother wwwww aaaaaaaaaa internationalisation x".split()]
    flat = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    ids, counts = bpe.encode_pieces(flat, np.cumsum(sizes) - sizes, sizes, vocabulary)
    single = [bpe.merge_one(vocabulary.byte_id[np.frombuffer(w, np.uint8)].tolist(), vocabulary) for w in words]
    assert ids.tolist() == [i for one in single for i in one]
    assert counts.tolist() == [len(one) for one in single]


def test_forgetting_pieces_changes_nothing(texts, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    encoder, _ = bpe.segment_tree_encoder(VOCABULARY)
    for _ in range(2):
        assert [x.tolist() for x in encoder.texts(texts[-20:])] == [
            library.encode(t, add_special_tokens=False).ids for t in texts[-20:]
        ]


def test_rows(docs, library):
    long = "word é " * 400_000
    rows = bpe.encoded(docs((1, "the cat"), (1, "the cat"), (None, ""), (3, None), (4, long)), VOCABULARY).collect()
    found = sorted(((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in rows), key=lambda r: (r[0], len(r[1])))
    cat = library.encode("the cat", add_special_tokens=False).ids
    assert found[:4] == [(0, [], ""), (1, cat, "the cat"), (1, cat, "the cat"), (3, [], "")]
    assert found[4][1] == library.encode(long, add_special_tokens=False).ids and found[4][2] == long
    assert bpe.encoded(docs((1, "x")).where("false"), VOCABULARY).count() == 0


def alternating(n):
    """A word whose letters follow the parity of the bits of their place, and its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [4, 95, 96, 97, 1024, 2048, 4096])
def test_hashes_of_complements_differ(size):
    word, other = alternating(size)
    codes = ct.codes_of(word + other + word)
    starts = np.array([0, size, 2 * size])
    first, second, third = ct.slice_hashes(codes, starts, starts + size).tolist()
    assert first != second and first == third


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_complements_encode_as_the_librarys(docs, library, size):
    word, other = alternating(size)
    text = f"{word}\n{other}"
    row = bpe.encoded(docs((1, text)), VOCABULARY).first()
    assert row["ids"] == library.encode(text, add_special_tokens=False).ids and row["decoded"] == text


def test_colliding_hashes_change_nothing(texts, library):
    _, vocabulary = bpe.segment_tree_encoder(VOCABULARY)
    few = lambda codes, starts, ends: (ends - starts).astype(np.uint64) % 3
    encoder = bpe.Encoder(lambda *pieces: bpe.encode_pieces(*pieces, vocabulary), vocabulary.special, few)
    for _ in range(2):
        for text, ids in zip(texts[-40:], encoder.texts(texts[-40:]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids

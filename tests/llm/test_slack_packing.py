import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from llm_cases import SMALL, docs  # noqa: F401
from tokenizers import Tokenizer

from orderlens.llm import bpe
from orderlens.llm import slack_packing as sp
from orderlens.llm.queries import QUERIES, WORD_VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


OTHERS = "ab's'tT'll 've're\n\n\t  d é中1２Ⅷ.,!! 　\x0b\x01\x1c\x85😀éÉΣσ́ͅ<|endoftext|>\U00016130"
LATIN = "ab's'tT'll 've're 'd'm''sß\n\t\x0b\x0c\r\x1c\x85\xa0\xad 12²½ªº.,!!<|>ÉÀÿ×÷ĀŁŉŸſµ\x01\x7f\x80"


@pytest.mark.parametrize("signs", [OTHERS, LATIN, LATIN + "İ"])
def test_ids_are_the_librarys(library, signs):
    fuzz = random.Random(2)
    texts = ["".join(fuzz.choice(signs) for _ in range(fuzz.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>", "á ́ Σ ΑΣ\nΑΣ", "a" * 5000 + " " + "é" * 300, "x" * 200 + "\n" + "don't" * 30]
    encoder = sp.WordEncoder(WORD_VOCABULARY)
    for some in (texts, texts[::-1]):
        for text, ids in zip(some, encoder.texts(some), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_latin_character(library):
    texts = [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}'s" for i in range(0x180)]
    for text, ids in zip(texts, sp.WordEncoder(WORD_VOCABULARY).texts(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_parts_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe.safe_chunks, "__defaults__", (7,))
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    text = "It's 12 words,\tor so;\n\nécole ecole 's " * 20
    encoder = sp.WordEncoder(WORD_VOCABULARY)
    for _ in range(3):
        assert next(encoder.texts([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_fullest_choice_equals_all_choices():
    fuzz = random.Random(4)
    for _ in range(300):
        lengths = sorted((fuzz.randint(1, 30) for _ in range(fuzz.randint(0, 9))), reverse=True)
        room = fuzz.randint(0, 60)
        best = max(
            (sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room), default=0
        )
        counted = [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]
        chosen = sp.fullest(counted, room)
        assert sum(chosen) == best
        assert all(chosen.count(x) <= lengths.count(x) for x in chosen)


def pieces(lengths):
    return [sp.Piece(i, 0, 0, n, ()) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("pool", [1, 2, 7, 1000])
def test_every_piece_lies_in_one_sequence(pool):
    fuzz = random.Random(pool)
    made = pieces([fuzz.randint(1, 100) for _ in range(500)])
    bins = list(sp.place(made, 100, pool))
    assert sorted(p.key for b in bins for p in b) == list(range(500))
    assert all(sum(p.length for p in b) <= 100 for b in bins)


def test_sequences_are_few():
    fuzz = random.Random(1)
    lengths = [min(2048, int(fuzz.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000)]
    bins = list(sp.place(pieces(lengths)))
    assert len(bins) <= -(-sum(lengths) // 2048) + 1
    # Pieces above half a sequence cannot share one; equal lengths fill it as often as they fit.
    assert len(list(sp.place(pieces([1100] * 50)))) == 50
    assert len(list(sp.place(pieces([600] * 50)))) == 17


def check_rows(rows, texts, library, tokens=2048):
    """The rows of distinct ids hold every id of every text once, in sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        cut = [ids[i : i + tokens] for i in range(0, len(ids), tokens)]
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [(k, k * tokens, len(c)) for k, c in enumerate(cut)]
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens
    return len(by_sequence)


def test_registered_query(spark, library):
    rows = QUERIES["op12_slack_packing"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sequences = check_rows(rows, texts, library)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert sequences <= least + len({r["sequence_id"] >> 32 for r in rows})


def test_rows(docs, library):
    long = "word é 12 " * 60_000
    texts = {1: "the cat", 2: None, 3: "", 4: long}
    df = docs(*texts.items())
    rows = sp.packed(df, WORD_VOCABULARY, projection=sp.CHECKSUM).collect()
    check_rows(rows, texts, library)
    whole = sp.packed(df.where("doc_id < 4"), WORD_VOCABULARY).collect()
    assert {r["doc_id"]: r["ids"] for r in whole}[1] == [*library.encode("the cat").ids, 0]
    repeated = sp.packed(docs((None, "x"), (None, "x"), (7, "x"), (7, "x")), WORD_VOCABULARY).collect()
    assert [r["length"] for r in repeated] == [2] * 4 and sum(r["doc_id"] is None for r in repeated) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in repeated}) == 4
    assert sp.packed(docs((1, "x")).where("false"), WORD_VOCABULARY).count() == 0

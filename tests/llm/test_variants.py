import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import docs  # noqa: F401

from orderlens.llm import variants as v
from orderlens.sources.scratch import materialize


def brute(rows, shortest=7, rarest=2):
    """The same by comparing all words with each other."""
    counts = {}
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= rarest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w, n in counts.items():
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        form = others[0] if others and counts[others[0]] >= 10 * n else None
        found[w] = (form, n, len(others), counts[form] if form else None)
    def root(w):
        return root(found[w][0]) if found[w][0] else w
    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in found.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_words_of_few_letters(docs, seed):
    """Few letters make many neighbours, repeated letters and chains of forms."""
    fuzz = random.Random(seed)
    made = ["".join(fuzz.choice("aabé") for _ in range(fuzz.randint(2, 6))) for _ in range(60)]
    weights = [10 ** fuzz.randint(0, 3) for _ in made]
    rows = [(i, " ".join(fuzz.choices(made, weights, k=400)) + f" {fuzz.choice(made)}") for i in range(12)]
    rows[0] = (0, rows[0][1].upper() + " ÀÉ×÷ÿ")
    # A short bound, so that words have neighbours of every kind.
    want = brute(rows, 3, 1)
    assert rows_of(v.grouped(docs(*rows), shortest=3, rarest=1)) == want
    assert any(w[4] > 3 for w in want) and any(w[1] for w in want)


def test_chain_of_forms(docs):
    counts = {"abcdefgh": 3000, "abcdefgx": 250, "abcdefyx": 20, "abcdezyx": 2, "unrelated": 5, "once only": 1}
    rows = [(i, " ".join([word] * n)) for i, (word, n) in enumerate(counts.items())]
    rows = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1].split()[0]}".encode()) % 31]
    found = {r[0]: r[1:] for r in rows_of(v.grouped(docs(*rows)))}
    assert found["abcdezyx"] == ("abcdefyx", "abcdefgh", 2, 1, 20)
    assert found["abcdefgx"] == ("abcdefgh", "abcdefgh", 250, 2, 3000)
    assert found["unrelated"] == (None, "unrelated", 5, 0, None)


def test_ties_take_the_first_word(docs):
    rows = [(1, "worldsa " * 20 + "worldsc " * 20 + "worldsb " * 2)]
    found = {r[0]: r[1] for r in rows_of(v.grouped(docs(*rows)))}
    assert found["worldsb"] == "worldsa" and found["worldsa"] is None


def test_tries_number_each_prefix_once():
    fuzz = random.Random(5)
    words = sorted({"".join(fuzz.choice("ab") for _ in range(fuzz.randint(1, 8))) for _ in range(200)})
    trie, seen = v.Trie(1), {}
    for word in words:
        nodes = trie.add(word)
        assert len(nodes) == len(word) + 1 and nodes[0] == 0
        for depth, node in enumerate(nodes):
            assert seen.setdefault(word[:depth], node) == node
    assert sorted(seen.values()) == list(range(len(seen)))


def test_partitions_share_nodes(spark):
    """Words that share prefixes lie in several partitions; their nodes are renamed to the first."""
    fuzz = random.Random(6)
    words = sorted({"common" + "".join(fuzz.choice("abc") for _ in range(fuzz.randint(0, 7))) for _ in range(300)})
    table = materialize(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), "words")
    numbered = v._numbered(table, ["n"], "trie")
    names = v._renamed(numbered)
    rows = numbered.orderBy("place").collect()
    assert [r["word"] for r in rows] == words and len({r["part"] for r in rows}) > 1
    seen = {}
    for r in rows:
        for depth, node in enumerate(v._replaced(np.array(r["nodes"], np.int64), names).tolist()):
            assert seen.setdefault(r["word"][:depth], node) == node
    assert len(set(seen.values())) == len(seen)


def test_cases(docs):
    long = "q" * 30_000
    rows = [(None, "Étrange étrange"), (None, "Étrange"), (2, None), (3, ""), (4, "short words do"), (5, f"{long} {long}"), (5, f"{long} {long}")]
    assert rows_of(v.grouped(docs(*rows))) == brute(rows)
    assert v.grouped(docs((1, "x")).where("false")).count() == 0


def test_tasks_hand_on_what_they_hold(docs, monkeypatch):
    rows = [(i, "counting words overall " * 3) for i in range(9)]
    monkeypatch.setattr(v, "HELD_WORDS", 1)
    assert rows_of(v.grouped(docs(*rows))) == brute(rows)

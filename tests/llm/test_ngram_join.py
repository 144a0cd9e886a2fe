import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import SMALL, docs  # noqa: F401

from orderlens.llm import cells, ngram_join
from orderlens.llm.components import components
from orderlens.llm.ngram_join import Bound


def shingles(text, words):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def by_hand(rows, words, top):
    sets = {i: shingles(t, words) for i, t in rows}
    edges = [
        (a, b)
        for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), root) for i, root in roots(edges, sets).items()}


def near_copies():
    """Chains and groups of near copies around the bound, with shared passages and short texts."""
    fuzz = random.Random(9)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [fuzz.choice(vocabulary) for _ in range(12)]
    made = []
    for _ in range(6):
        text = [fuzz.choice(vocabulary) for _ in range(fuzz.randint(20, 80))] + passage
        for _ in range(8):
            made.append(" ".join(text))
            text = list(text)
            text[fuzz.randrange(len(text))] = fuzz.choice(vocabulary)  # the next one differs from this one
    made += [" ".join(passage + [f"x{i}"]) for i in range(10)] + ["A b", "a B", "a b c", "", " \n", "one", "é é é é é é"]
    return list(enumerate(made))


@pytest.mark.parametrize("words,top", [(4, 85), (5, 80), (1, 60)])
@pytest.mark.parametrize("minhash", [True, False])
def test_components_are_exact(spark, docs, monkeypatch, words, top, minhash):  # noqa: F811
    if not minhash:  # the search alone finds all links
        monkeypatch.setattr(ngram_join, "_near_minhash", lambda nodes, bound: spark.createDataFrame([], "a long, b long"))
        monkeypatch.setattr(ngram_join, "NODE_BLOCK", 3)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = near_copies()
    got = ngram_join.joined(docs(*rows), words, Bound(top, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows, words, top)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = ngram_join.joined(df, 4, Bound(85, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows, 4, 85)


def test_odd_rows(docs):  # noqa: F811
    same = "one two three four five six"
    rows = [(5, same), (3, same), (3, same), (None, same), (7, None), (8, ""), (9, "long " * 200_000), (2, "long " * 200_001)]
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs(*rows)).collect()))
    assert got == [(0, 2, None), (2, 1, 2), (3, 2, 3), (3, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 2)]
    assert ngram_join.joined(docs(*rows).where("false")).count() == 0


def test_repeated_ids(docs):  # noqa: F811
    """All texts of an id count, also where they differ, and all its rows have one component."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(9))
    c = " ".join(f"c{i}" for i in range(30))
    rows = [(7, a), (7, b), (5, a), (3, b), (7, None), (7, c + " x"), (20, c + " y"), (21, c + " z"), (30, None), (30, "d e f")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.joined(docs(*rows)).collect())
    assert got == [(i, 30 if i == 30 else 3) for i in sorted(i for i, _ in rows)]


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_of_complementary_letters_differ(docs, size):  # noqa: F811
    word = "".join("ab"[i.bit_count() % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    got = ngram_join.joined(docs((1, f"{word} x y z"), (2, f"{other} x y z")), 4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2)]


def test_search_of_blocks_equals_counting():
    fuzz = random.Random(8)
    bound = Bound(85, 100)
    for _ in range(50):
        sizes = {node: fuzz.randint(3, 30) for node in range(20)}
        group = {node: fuzz.randrange(6) for node in sizes}
        lists = [sorted(fuzz.sample(range(20), fuzz.randint(2, 15)), key=lambda x: (sizes[x], x)) for _ in range(12)]
        sides = [[x for x in one if x % 2 == 0] for one in lists], [[x for x in one if x % 2] for one in lists]
        rows = [
            tuple(v for side in pair for v in (side, [group[x] for x in side], [sizes[x] for x in side]))
            for pair in zip(*sides, strict=True)
        ]
        found = {q: sorted(c) for q, c in ngram_join.search_block(rows, bound)}
        want = {}
        for q in range(0, 20, 2):
            need = int(min(bound.occurrences(sizes[q]), bound.occurrences(bound.least(sizes[q]))))
            fits = lambda c: (sizes[c], c) < (sizes[q], q) and group[c] != group[q] and 100 * sizes[c] >= 85 * sizes[q]  # noqa: B023, E731
            times = Counter(c for one, other in zip(*sides, strict=True) if q in one for c in other if fits(c))
            if met := sorted(c for c, n in times.items() if n >= need):
                want[q] = met
        assert found == want


def test_frequent_cells(spark):
    """Counts by cell against a plain count; messages are added up in several groups."""
    fuzz = np.random.default_rng(3)
    hashes = fuzz.integers(0, 1 << 64, 5_000, np.uint64, endpoint=False)
    hashes = np.concatenate([hashes, np.repeat(hashes[:300], 7)])
    for bits in (16, 22):
        rows = []
        for some in np.array_split(fuzz.permutation(hashes), 9):
            gatherer = cells.Gatherer(bits)
            rows += gatherer.add(some) + gatherer.rest()
        messages = spark.createDataFrame([(p, bytearray(m)) for p, m in rows], "part int, packed binary")
        want = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) >= 4
        table = cells.frequent(messages, bits, 4)
        assert (np.unpackbits(table, bitorder="little").astype(bool) == want).all()
        assert (cells.contains(table, hashes, bits) == want[(hashes >> np.uint64(64 - bits)).astype(np.int64)]).all()


def test_divide_skip():
    fuzz = random.Random(5)
    for _ in range(2000):
        lists = [sorted(fuzz.sample(range(30), fuzz.randint(0, 12))) for _ in range(fuzz.randint(0, 9))]
        lists += [sorted(fuzz.sample(range(300), 100)) for _ in range(fuzz.randint(0, 3))]
        least = fuzz.randint(1, 5)
        times = Counter(v for one in lists for v in one)
        assert ngram_join.divide_skip(lists, least) == sorted(v for v in times if times[v] >= least)


def test_components(spark):
    fuzz = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    edges += [(fuzz.randrange(300, 400), fuzz.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == roots(edges, {n for e in edges for n in e})

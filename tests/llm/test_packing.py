from collections import defaultdict

import numpy as np
import pytest
from llm_cases import SMALL, docs  # noqa: F401
from tokenizers import Tokenizer

from orderlens.llm import packing
from orderlens.llm.packing import Example, Limits, Packer
from orderlens.llm.queries import VOCABULARY


def check(pieces, lengths, limits):
    """Each id once, sequences gapless and within all limits; returns the tokens of each."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for key, start, length, sequence, offset, loss in pieces:
        parts[key].append((start, length))
        sequences[sequence].append((offset, length, loss))
    for key, length in lengths.items():
        end = 0
        for start, n in sorted(parts[key]):
            assert start == end and n > 0
            end += n
        assert end == length
    for placed in sequences.values():
        end = 0
        for offset, n, _ in sorted(placed):
            assert offset == end
            end += n
        assert end <= limits.tokens and len(placed) <= limits.segments and sum(p[2] for p in placed) <= limits.loss
    return {s: sum(p[1] for p in placed) for s, placed in sequences.items()}


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    library = Tokenizer.from_file(VOCABULARY)
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for r in df.collect()}
    rows = packing.packed(df, VOCABULARY).collect()
    for r in rows:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
    pieces = [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], r["loss_tokens"]) for r in rows]
    full = check(pieces, {k: len(v) for k, v in ids.items()}, Limits())
    assert sum(full.values()) / len(full) > 0.98 * 1024


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [Limits(100, 4, 60), Limits(64, 64, 64), Limits(50, 2, 20)])
def test_all_limits_hold(cut, limits):
    random = np.random.default_rng(4)
    packer, pieces, lengths = Packer(limits, cut), [], {}
    for window in range(3):
        made = []
        for i in range(60):
            n = int(random.integers(0, limits.tokens * (3 if cut else 1)))
            bears = random.random(n) < 0.3
            if not cut:
                bears &= np.cumsum(bears) <= limits.loss
            made.append(Example((window, i), np.arange(n), np.append(0, np.cumsum(bears))))
            lengths[(window, i)] = n
        pieces += [
            (p.example.key, p.start, p.length, p.sequence, p.offset, p.example.loss(p.start, p.start + p.length))
            for p in packer.place(made)
        ]
    check(pieces, lengths, limits)
    if not cut:
        assert all(start == 0 for _, start, *_ in pieces)


def test_dot_product_prefers_what_is_plentiful():
    # Once A has used the loss budget, B (no loss) suits the rest better than C of the same size.
    bearing = lambda n, k: np.append(0, np.minimum(np.arange(1, n + 1), k))
    a, b, c = Example("A", np.arange(60), bearing(60, 50)), Example("B", np.arange(30), bearing(30, 0)), Example("C", np.arange(30), bearing(30, 10))
    placed = [(p.example.key, p.sequence) for p in Packer(Limits(100, 8, 55), cut=False).place([c, b, a])]
    assert placed[0][0] == "A" and dict(placed)["B"] == dict(placed)["A"] != dict(placed)["C"]


def test_rows(docs):
    rows = packing.packed(docs((1, None), (2, ""), (None, "word"), (2, "")), VOCABULARY).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (1, 1), (2, 1), (2, 1)]
    assert packing.packed(docs((1, "x")).where("false"), VOCABULARY).count() == 0


def test_instruction_examples(spark):
    df = spark.createDataFrame(
        [(1, [5] * 30, [True] * 10), (2, None, None), (3, [7] * 40, [None] * 40), (4, [], [True])],
        "id int, ids array<int>, flags array<boolean>",
    )
    rows = packing.packed_examples(df, "id", "ids", "flags", Limits(64, 4, 32)).collect()
    assert {r["id"]: (r["length"], r["loss_tokens"]) for r in rows} == {1: (30, 10), 3: (40, 0)}
    with pytest.raises(Exception, match="does not fit"):
        packing.packed_examples(df, "id", "ids", "flags", Limits(35, 4, 32)).collect()

import hashlib

import pytest
from llm_cases import docs  # noqa: F401
from pyspark.sql import functions as F

from orderlens.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows, changed):
    """Trees with Python lists: rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf(row), leaf(changed(row))))
    first = lambda k: (k is not None, k.encode() if isinstance(k, str) else k)

    def levels(nodes):
        made = [nodes]
        while len(made[-1]) > 1:
            made.append([digest("".join(made[-1][i : i + 3])) for i in range(0, len(made[-1]), 3)])
        return made

    trees = {}
    for name in sorted(groups, key=first):
        groups[name].sort(key=lambda r: (first(r[0]), r[1]))
        trees[name] = levels([r[1] for r in groups[name]])
    top = levels([t[-1][0] for t in trees.values()])
    root = top[-1][0]
    found = []
    for k, (name, members) in enumerate(groups[n] and (n, groups[n]) for n in trees):
        for i, (key, own, other) in enumerate(members):
            folded, proof = other, ""
            for tree, at in ((trees[name], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    proof += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    folded = digest("".join([*run[: at % 3], folded, *run[at % 3 + 1 :]]))
                    at //= 3
            found.append((key, own, trees[name][-1][0], root, proof, folded, folded == root))
    return sorted(found, key=str)


def manifest(df):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.manifest(df, COLUMNS, {"text": F.coalesce(text, "text")})


def changed(row):
    same = row[4] is None or row[0] is None or row[0] % 2
    return row if same else (*row[:4], row[4].replace("\n", ""))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest(df.withColumns({c: F.lit(c) for c in ("id", "of", "leaf", "tree", "idx", "digest", "n", "step")}))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, changed)


SIZES = [[1], [2], [3], [4], [1, 1], [1, 1, 1, 1], [9, 1, 10], [28, 3, 2, 1, 5, 82]]


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_trees_of_many_sizes(spark, sizes):
    rows = []
    for g, size in enumerate(sizes):
        name = [None, "b", "a", "é", "z", "Z"][g]
        rows += [(i * 7 % 101 + 200 * g, name, "en", i, f"line {i}\nline" * (i % 3)) for i in range(size)]
    check(spark, rows)


def test_cases(spark):
    long = "a word\n" * 300_000
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, "x\ny"),
        (4, "s", "en", 1, "x\ny"), (4, "s", "en", 1, "x\ny"), (4, "s", "en", 1, "other"), (5, "s", "en", 0, ""),
        (6, "s", "en", 7, long), (8, "", "é", -1, "é\n"),
    ]
    check(spark, rows)


def test_empty_table_and_limit(spark, docs):
    assert manifest(docs((1, "x")).where("false")).count() == 0
    spark.conf.set(merkle.ROW_LIMIT, 5)
    try:
        # The limit of recursive queries is lifted for the climb alone.
        assert manifest(docs(*[(i, "x") for i in range(40)])).count() == 40
        assert spark.conf.get(merkle.ROW_LIMIT) == "5"
    finally:
        spark.conf.unset(merkle.ROW_LIMIT)


def test_the_climb_is_recursive_and_broadcasts_nothing_by_hint(spark, docs, capsys):
    starts = spark.createDataFrame(
        [(0, 0, 0, 0, 0, b"x", b"y")], "leaf long, id long, tree long, level long, idx long, folded binary, original binary"
    )
    runs = spark.createDataFrame(
        [], "tree long, level long, run long, children binary, up_tree long, up_level long, up_idx long"
    )
    starts.createOrReplaceTempView("s")
    runs.createOrReplaceTempView("r")
    spark.sql(merkle.CLIMB.format(starts="s", runs="r")).explain("extended")
    plan = capsys.readouterr().out
    assert "UnionLoop" in plan and "Cartesian" not in plan

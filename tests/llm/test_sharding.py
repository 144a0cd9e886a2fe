import zlib
from collections import defaultdict

import pytest
from llm_cases import SMALL, docs  # noqa: F401
from pyspark.sql import functions as F

from orderlens.llm import sharding


@pytest.mark.parametrize("dimensions,bits", [(1, 3), (2, 1), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_in_single_steps(spark, dimensions, bits):
    n = 2**bits
    point = F.array(*(F.floor(F.col("id") / n**i).cast("int") % n for i in range(dimensions)))
    rows = spark.range(n**dimensions).select(point.alias("p")).select("p", sharding.hilbert_index(F.col("p"), dimensions, bits).alias("h"))
    order = sorted((r["h"], tuple(r["p"])) for r in rows.collect())
    assert [h for h, _ in order] == list(range(n**dimensions))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(order, order[1:]))


def law_holds(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r["doc_id"]: r for r in df.collect()}
    rows = sharding.sharded(df, ["lang", "source", "n_chars"], 24).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    law_holds(rows, 24)
    for r in rows:
        raw = text[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    curve = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)
    langs = defaultdict(set)
    for r in rows:
        langs[r["shard"]].add(text[r["doc_id"]]["lang"])
    assert sum(map(len, langs.values())) / 24 < 3  # of four: a reader skips shards by language


def test_odd_rows(spark, docs):  # noqa: F811
    df = docs((3, None), (1, ""), (None, "é"), (1, ""), (7, "é" * 100_000), (7, "x")).withColumn("lang", F.when(F.col("doc_id") == 1, "de"))
    rows = sharding.sharded(df, ["lang", "n_chars"], 4).collect()
    law_holds(rows, 4)
    assert sorted(r["size"] for r in rows) == [8, 8, 8, 9, 10, 200_008]
    law_holds(sharding.sharded(df, ["lang"], 24).collect(), 24)  # fewer rows than shards
    assert sharding.sharded(df.where("false"), ["lang", "n_chars"], 4).count() == 0


def test_a_hot_group_is_cut(docs):  # noqa: F811
    law_holds(sharding.sharded(docs(*((i, "same") for i in range(100))), ["lang", "source"], 8).collect(), 8)


def test_files(spark, tmp_path, docs):  # noqa: F811
    df = docs(*((i, "x" * i) for i in range(40)))
    sharding.write_shards(df, ["n_chars"], 4, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40 and back.select("shard").distinct().count() == 4


def test_written_shards_keep_null_and_repeated_ids(spark, docs, tmp_path):  # noqa: F811
    rows = [(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, None), (4, "d d d")]
    df = docs(*rows).withColumns({"_row0": F.lit(1), "slot": F.lit("x")})
    sharding.write_shards(df, ["n_chars", "lang"], 4, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, rows))
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and {*df.columns, "shard"} == set(back.columns)
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(df.withColumn("shard", F.lit(1)), ["n_chars"], 4, f"{tmp_path}/other")

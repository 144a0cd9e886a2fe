import numpy as np
import pytest
from llm_cases import docs  # noqa: F401
from pyspark.sql import functions as F

from orderlens.llm import quality, toxicity
from orderlens.llm.labelled import held_out, training_sample
from orderlens.llm.textstats import Texts

LARGER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


def outcome(scores, labels, label, threshold):
    rows = scores.join(labels, "doc_id").where(held_out()).select("score", label).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [((r["score"] >= threshold), r[label]) for r in rows]


def test_quality_on_held_out_documents(spark):
    df, labels = tables(spark)
    rows = outcome(quality.scored(df, quality.fit(df, labels)), labels, "quality", 0.7)
    assert sum(guess == bool(y) for guess, y in rows) / len(rows) >= 0.95


def test_toxicity_on_held_out_documents(spark):
    df, labels = tables(spark)
    rows = outcome(toxicity.scored(df, toxicity.fit(df, labels)), labels, "toxic", 0.3)
    clean = [guess for guess, y in rows if not y]
    assert sum(clean) / len(clean) <= 0.05
    toxic = [guess for guess, y in rows if y]
    assert sum(toxic) / len(toxic) >= 0.5  # some labels of this small table are noise


def test_pairs_by_the_identity():
    random = np.random.default_rng(2)
    width = quality.BUCKETS + 2 * quality.BINS
    model = quality.Model(np.zeros((2, quality.BINS - 1)), 0.3, random.normal(size=width), random.normal(size=(width, 4)))
    texts = Texts(["a b c a", "", "b"])
    owner, column, value = quality.word_columns(texts)
    bins = quality.statistic_columns(random.normal(size=(3, 2)), model.cuts)
    got = quality.raw_scores(model, 3, owner, column, value, bins)
    for i in range(3):
        x = [*zip(column[owner == i], value[owner == i]), *((b, 1 / np.sqrt(2)) for b in bins[i])]
        want = model.bias + sum(model.weights[c] * v for c, v in x)
        want += sum((model.vectors[c] @ model.vectors[d]) * v * u for k, (c, v) in enumerate(x) for d, u in x[:k])
        assert got[i] == pytest.approx(want)
    assert sum(value[owner == 0] ** 2) == pytest.approx(1)


def test_dense_features():
    look_up = toxicity._Lookup(toxicity.Lexicon(*map(list, zip(*sorted([(_signed("idiot"), 4.0)])))))
    second = np.array([toxicity.word_hash(w) for w in toxicity.SECOND_PERSON], np.uint64)
    texts = Texts(["You IDIOT! so good", "id1ot id10t", "", "nothing here at all", "a b c d e f g idiot"])
    values = toxicity.features(texts, look_up, second, toxicity._fold_table())
    at = toxicity.FEATURES.index
    assert values[0, at("hit_density")] == 0.25 and values[0, at("near_second")] == 0.25 and values[0, at("top_weight")] == 4
    assert values[0, at("capitals")] == pytest.approx(6 / 14) and values[0, at("exclamations")] == pytest.approx(1 / 18)
    assert values[1, at("folded_hits")] > 0 and values[1, at("mixed_words")] > 0
    assert not values[2].any() and not values[3, : at("capitals")].any()
    assert values[4, at("near_second")] == 0


def _signed(word):
    return int(np.array([toxicity.word_hash(word)], np.uint64).view(np.int64)[0])


def test_sample_is_bounded_and_repeatable(spark):
    df, labels = tables(spark)
    rows = [training_sample(d, labels, "quality", 20).rows.orderBy("doc_id").collect() for d in (df, df.repartition(7))]
    assert rows[0] == rows[1] and sum(r["label"] for r in rows[0]) <= 20
    ids = spark.createDataFrame([(r["doc_id"],) for r in rows[0]], "doc_id long")
    assert ids.where(held_out()).count() == 0


@pytest.mark.parametrize("part,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, docs, part, label):  # noqa: F811
    df, labels = tables(spark)
    odd = docs((1, None), (2, ""), (None, "idiot"), (4, "!!! ???"), (4, "!!! ???"), (5, "word " * 300_000))
    for model in (part.fit(df, labels), part.fit(odd, labels.where("false")), part.fit(odd, labels.withColumn(label, F.lit(None).cast("int")))):
        rows = part.scored(odd, model).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
        kept = part.scored(odd, model, keep=odd.columns)
        assert kept.columns == [*odd.columns, "_score"] and kept.count() == 6
        assert part.scored(odd.where("false"), model).count() == 0

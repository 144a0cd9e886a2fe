"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is a short list of insults plus terms learned from labelled documents: words and word
beginnings (so that inflected forms count) that are far more frequent in toxic texts.  The features
are densities of lexicon hits, their nearness to the second person, capitals, punctuation and
signs of obfuscation.  Lexicon, trees and calibration each learn from their own part of the sample,
so that the trees see the lexicon as it behaves on texts it was not made from.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm import chartext as ct
from orderlens.llm.bpe import LETTER, SPACE, small_batches, text_or_empty
from orderlens.llm.labelled import Sample, training_sample
from orderlens.llm.textstats import Texts, ratio, upper_flags
from orderlens.llm.workers import released
from orderlens.sources.scratch import materialize

# Parameters: the most labelled documents of each class that are learned from, and the most
# learned lexicon terms.
PER_CLASS = 4000
LEXICON_TERMS = 400

# Insults that count without any training, and second-person words.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown "
    "arschloch dummkopf abschaum connard imbécile ordure estúpido imbécil basura"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre ti usted ustedes "
    "vosotros"
).split()

PREFIXES = (4, 5, 6)
NEAR = 5
FOLDS_LEXICON, FOLDS_TREES = (0, 1, 2), (3, 4, 5)  # the rest calibrate

FEATURES = (
    "hit_density", "hit_log", "weight_density", "top_weight", "near_second", "second_density", "capitals",
    "capital_words", "punctuation", "exclamations", "digits", "mixed_words", "stretched", "folded_hits", "length_log",
)

# Characters written in place of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}


class Lexicon(NamedTuple):
    terms: list[int]  # hashes as signed longs, ascending as unsigned
    weights: list[float]


def _salted(hashes: np.ndarray, salt: int) -> np.ndarray:
    return ct.mix(hashes ^ np.uint64(salt))


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return texts.spans(texts.kind == LETTER)


def _terms(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings (of words longer than those)."""
    whole = ct.slice_hashes(texts.lower, starts, ends)
    cuts = [ct.slice_hashes(texts.lower, starts, np.minimum(ends, starts + p)) for p in PREFIXES]
    return [_salted(whole, 0)] + [
        np.where(ends - starts > p, _salted(h, p), np.uint64(0)) for p, h in zip(PREFIXES, cuts, strict=True)
    ]


def word_hash(word: str) -> int:
    codes = ct.codes_of(word)
    return int(_salted(ct.slice_hashes(codes, np.array([0]), np.array([len(codes)])), 0)[0])


class _Lookup:
    """Weights of term hashes: a bit table first, since almost no word is a term."""

    def __init__(self, lexicon: Lexicon):
        self.keys = np.array(lexicon.terms, np.int64).view(np.uint64)
        self.weights = np.array(lexicon.weights)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes))
        if not len(self.keys):
            return found
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[at]
        found[at[hit]] = self.weights[place[hit]]
        return found


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for a, b in LOOKALIKES.items():
        table[ord(a)] = ord(b)
    return table


def features(texts: Texts, look_up: _Lookup, second: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """One row of `FEATURES` for each text; a text without words has zeros."""
    starts, ends, owner = _words(texts)
    terms = _terms(texts, starts, ends)
    weight = np.maximum.reduce([look_up(t) for t in terms]) if len(starts) else np.zeros(0)
    hit = weight > 0
    n_words = texts.per_text(owner)
    pronoun = np.isin(terms[0], second)
    # Words at most NEAR words from a pronoun of the same text.
    place = np.flatnonzero(pronoun)
    near = np.zeros(len(starts), bool)
    for k in np.flatnonzero(hit) if len(place) else ():
        for p in place[max(0, np.searchsorted(place, k) - 1) : np.searchsorted(place, k) + 1]:
            near[k] |= abs(int(p) - int(k)) <= NEAR and owner[p] == owner[k]
    top = np.zeros(texts.n)
    np.maximum.at(top, owner[hit], weight[hit])
    hits = texts.per_text(owner[hit])
    shape = texts.shape()
    letters, digits, others, upper, marks = shape[:, 0], shape[:, 1], shape[:, 2], shape[:, 3], shape[:, 4]
    caps = np.append(0, np.cumsum(upper_flags()[texts.codes]))
    shouted = (ends - starts > 2) & (caps[ends] - caps[starts] == ends - starts)
    # Tokens that hold both letters and other signs inside, and their look-alike reading.
    is_letter = np.append(0, np.cumsum(texts.kind == LETTER))
    inner = np.append(0, np.cumsum((texts.kind != LETTER) & (texts.kind != SPACE)))
    s, e = texts.starts, texts.ends
    inside = (e - s > 3) & (is_letter[e] - is_letter[s] >= 2) & (inner[e - 1] - inner[s] >= 1)
    at = np.flatnonzero(inside)
    folded = fold[texts.lower]
    last = texts.kind[e[at] - 1] != LETTER
    read = look_up(_salted(ct.slice_hashes(folded, s[at], e[at] - last), 0)) if len(at) else np.zeros(0)
    same = np.zeros(len(texts.codes), bool)
    if len(same) > 2:
        same[2:] = (texts.lower[2:] == texts.lower[1:-1]) & (texts.lower[1:-1] == texts.lower[:-2]) & (texts.kind[2:] == LETTER)
    length = texts.sizes.astype(float)
    return np.stack(
        [
            ratio(hits, n_words),
            np.log1p(hits),
            ratio(texts.per_text(owner, weight), n_words),
            top,
            ratio(texts.per_text(owner[near & hit]), n_words),
            ratio(texts.per_text(owner[pronoun]), n_words),
            ratio(upper, letters),
            ratio(texts.per_text(owner[shouted]), n_words),
            ratio(others, length),
            ratio(marks, length),
            ratio(digits, length),
            ratio(texts.per_text(texts.owner[at]), n_words),
            ratio(texts.count(same), length),
            ratio(texts.per_text(texts.owner[at[read > 0]]), n_words),
            np.log1p(length),
        ],
        axis=1,
    )


def with_features(
    df: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text", inside: str | None = None
) -> DataFrame:
    """`keep` columns and the features of each text.

    With `inside`, the text is a field of that kept column, so that it is sent to the task once.
    """
    schema = df.select(*keep).schema
    for name in FEATURES:
        schema = schema.add(name, "double")
    n = len(keep)

    def work(batches):
        look_up = _Lookup(lexicon)
        second = np.array([word_hash(w) for w in SECOND_PERSON], np.uint64)
        fold = _fold_table()
        for batch in batches:
            if inside:
                texts = pc.fill_null(batch.column(batch.schema.get_field_index(inside)).field(text), "")
            else:
                texts = batch.column(n)
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), texts], names=["row", "text"])
            for rows, texts in small_batches(pair):
                values = features(Texts(texts), look_up, second, fold)
                part = batch.slice(rows[0].as_py(), len(rows))
                columns = [part.column(i) for i in range(n)] + [pa.array(values[:, k]) for k in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sent = df.select(*keep) if inside else df.select(*keep, text_or_empty(text))
    return sent.mapInArrow(released(work), schema)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms much more frequent in toxic texts: counted over the rows, best `LEXICON_TERMS` kept.

    A term counts once a text.  It needs at least three toxic texts and one in a hundred of them; its
    weight is the smoothed log odds, at least two.
    """

    def work(batches):
        for batch in batches:
            label = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["label", "text"])
            for labels, texts in small_batches(label):
                t = Texts(texts)
                starts, ends, owner = _words(t)
                toxic = labels.to_numpy(zero_copy_only=False) > 0
                for hashes in _terms(t, starts, ends):
                    found, text = _distinct(hashes, owner)
                    term, inverse = np.unique(found, return_inverse=True)
                    bad = np.bincount(inverse, toxic[text], minlength=len(term))
                    good = np.bincount(inverse, ~toxic[text], minlength=len(term))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(term.view(np.int64)), pa.array(bad), pa.array(good)], names=["term", "bad", "good"]
                    )

    counts = rows.groupBy("label").count().collect()
    n = {int(r["label"]): r["count"] for r in counts}
    bad_all, good_all = n.get(1, 0), n.get(0, 0)
    terms = (
        rows.select("label", "text")
        .mapInArrow(released(work), "term long, bad double, good double")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    odds = F.log((F.col("bad") + 0.5) / (bad_all + 1.0)) - F.log((F.col("good") + 0.5) / (good_all + 1.0))
    best = (
        terms.where(F.col("bad") >= max(3.0, 0.01 * bad_all))
        .withColumn("weight", odds)
        .where("weight >= 2")
        .orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "term")
        .limit(LEXICON_TERMS)
        .collect()
    )
    learned = {r["term"]: float(r["weight"]) for r in best}
    fixed = {int(np.array([word_hash(w)], np.uint64).view(np.int64)[0]): 4.0 for w in INSULTS}
    merged = sorted((fixed | learned).items(), key=lambda kv: kv[0] & 0xFFFFFFFFFFFFFFFF)
    return Lexicon([k for k, _ in merged], [v for _, v in merged])


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (hash, text) once, without empty hashes."""
    used = hashes != 0
    hashes, owner = hashes[used], owner[used]
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


class Model(NamedTuple):
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on at most `per_class` documents of each label; without both labels, a constant model."""
    sample: Sample = training_sample(docs, labels, label, per_class)
    if sample.rows is None:
        return Model(Lexicon([], []), None, None, sample.prior)
    lexicon = learn_lexicon(sample.rows.where(F.col("fold").isin(*FOLDS_LEXICON)))
    rest = sample.rows.where(~F.col("fold").isin(*FOLDS_LEXICON))
    table = materialize(
        with_features(rest, lexicon, ["label", "weight", "fold", "doc_id"]).repartition(1).sortWithinPartitions("doc_id"),
        "toxicity_features",
    ).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    grown = table.where(F.col("fold").isin(*FOLDS_TREES))
    if grown.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, sample.prior)
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxDepth=3, maxIter=12, stepSize=0.3, seed=7,
        minInstancesPerNode=5,
    ).fit(grown)
    held = trees.transform(table.where(~F.col("fold").isin(*FOLDS_TREES))).select("label", "weight", _probability().alias("raw"))
    calibration = None
    if held.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(held)
    return Model(lexicon, trees, calibration, sample.prior)


def _probability() -> Column:
    return vector_to_array("probability")[1]


def scored(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text: str = "text",
    score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """The id (or the columns `keep`) and `score` (0 to 1) of every row.

    Null texts count as empty, empty texts and texts without words are scored like any other from
    their zero features; repeated rows and null ids are scored each; other columns are not read.
    With `keep`, the score's column is `_score`, so that it clashes with no kept column.
    """
    columns, score = (keep, "_score") if keep else ([id_column], score)
    if model.trees is None:
        return docs.select(*columns, F.lit(float(model.prior)).alias(score))
    row = F.struct(*columns).alias("_row")  # kept columns may be called like features
    if text in columns:
        table = with_features(docs.select(row), model.lexicon, ["_row"], text, inside="_row")
    else:
        table = with_features(docs.select(row, F.col(text).alias("_text")), model.lexicon, ["_row"], "_text")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    table = model.trees.transform(table).select("_row", _probability().alias("raw"))
    if model.calibration is not None:
        table = model.calibration.transform(table).withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")))
    return table.select("_row.*", F.col("raw").alias(score))

"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text becomes a sparse vector: its words hashed to `BUCKETS` columns with the square root of their
share (so that the word block has length one), its structure statistics and its length each as one
of `BINS` columns cut at sample quantiles.  Each column has a weight and a vector of `RANK` numbers;
the score adds, to the linear part, the products of all pairs of columns, by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)``, in time
linear in the number of columns a text has.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm import chartext as ct
from orderlens.llm.bpe import LETTER, SPACE, small_batches, text_or_empty
from orderlens.llm.labelled import training_sample
from orderlens.llm.textstats import Texts, ratio
from orderlens.llm.workers import released

# Parameters: the most labelled documents of each class that are learned from, and the model's size.
PER_CLASS = 2500
BUCKETS = 1 << 14
BINS = 8
RANK = 6
EPOCHS = 12

STATISTICS = (
    "letters", "digits", "marks", "capitals", "exclamations", "line_length", "white_space", "word_length",
    "distinct_words", "repeated_words", "marked_words", "lone_marks", "top_word", "distinct_lines", "stop_shape",
    "length",
)


class Model(NamedTuple):
    """`cuts[k]`: inner bin edges of statistic k; weights and vectors of all columns."""

    cuts: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    constant: float | None = None


def word_columns(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, column and value of the hashed words, ordered by text."""
    hashes = ct.slice_hashes(t.lower, t.starts, t.ends)
    column = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    pair, count = np.unique(t.owner * BUCKETS + column, return_counts=True)
    owner = pair // BUCKETS
    words = t.per_text(t.owner)
    return owner, pair % BUCKETS, np.sqrt(count / words[owner])


def statistics(t: Texts) -> np.ndarray:
    """One row of `STATISTICS` for each text; a text without words has zeros for what needs them."""
    shape = t.shape()
    letters, digits, marks, upper, loud, lines, white = shape.T
    length = t.sizes.astype(float)
    words = t.per_text(t.owner)
    hashes = ct.slice_hashes(t.lower, t.starts, t.ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (t.owner[1:] == t.owner[:-1])
    order = np.lexsort((hashes, t.owner))
    h, o = hashes[order], t.owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(h)))
    top = np.zeros(t.n)
    np.maximum.at(top, o[begin], times)
    sign = (t.kind != LETTER) & (t.kind != SPACE)
    last_two = np.zeros(len(t.starts), bool)
    wide = np.flatnonzero(t.ends - t.starts > 2)
    last_two[wide] = sign[t.ends[wide] - 1] & sign[t.ends[wide] - 2]
    inner = np.append(0, np.cumsum(t.kind == LETTER))
    bare = inner[t.ends] == inner[t.starts]
    ends_plain = ~sign[t.ends - 1] if len(t.ends) else np.zeros(0, bool)
    line_start, line_end, line_owner = t.spans(t.codes != 0x0A)
    line_hash = ct.slice_hashes(t.codes, line_start, line_end)
    by_line = np.lexsort((line_hash, line_owner))
    lh, distinct = line_hash[by_line], line_owner[by_line]
    first = np.ones(len(lh), bool)
    first[1:] = (lh[1:] != lh[:-1]) | (distinct[1:] != distinct[:-1])
    n_lines = t.per_text(line_owner)
    return np.stack(
        [
            ratio(letters, length),
            ratio(digits, length),
            ratio(marks, length),
            ratio(upper, letters),
            ratio(loud, length),
            ratio(length, lines + 1),
            ratio(white, length),
            ratio(length - white, words),
            ratio(t.per_text(o[begin]), words),
            ratio(t.per_text(t.owner[again]), words),
            ratio(t.per_text(t.owner[last_two]), words),
            ratio(t.per_text(t.owner[bare]), words),
            ratio(top, words),
            ratio(t.per_text(distinct[first]), n_lines),
            ratio(t.per_text(t.owner[ends_plain]), words),
            np.log1p(length),
        ],
        axis=1,
    )


def statistic_columns(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The column of each statistic's bin, one row for each text."""
    bins = np.stack([np.searchsorted(cuts[k], values[:, k], side="left") for k in range(values.shape[1])], axis=1)
    return BUCKETS + np.arange(values.shape[1]) * BINS + bins


def raw_scores(model: Model, n: int, owner: np.ndarray, column: np.ndarray, value: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The machine's output before the logistic: words as sparse triples, statistics as bins."""
    share = 1.0 / np.sqrt(bins.shape[1])
    linear = np.bincount(owner, model.weights[column] * value, minlength=n) + model.weights[bins].sum(1) * share
    pairs = np.zeros(n)
    for f in range(model.vectors.shape[1]):
        v = model.vectors[:, f]
        word = v[column] * value
        total = np.bincount(owner, word, minlength=n) + v[bins].sum(1) * share
        squares = np.bincount(owner, word * word, minlength=n) + (v[bins] ** 2).sum(1) * share**2
        pairs += total * total - squares
    return model.bias + linear + 0.5 * pairs


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(
    texts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> Model:
    """Adaptive gradient descent on weighted log loss; the order of examples is fixed by a seed.

    `texts[i]` are word columns and values of example i, `values` the statistics.
    """
    width = BUCKETS + values.shape[1] * BINS
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = np.stack([np.quantile(values[:, k], inner) for k in range(values.shape[1])])
    bins = statistic_columns(values, cuts)
    share = 1.0 / np.sqrt(bins.shape[1])
    random = np.random.default_rng(11)
    model = Model(cuts, 0.0, np.zeros(width), random.normal(0, 0.05, (width, RANK)))
    w, v, bias = model.weights, model.vectors, np.log(((weight * label).sum() + 1) / ((weight * (1 - label)).sum() + 1))
    seen_w, seen_v, seen_b = np.full(width, 1e-3), np.full((width, RANK), 1e-3), 1e-3
    weight = weight / weight.mean()
    rate, decay = 0.1, 1e-4
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for begin in range(0, len(order), 32):
            batch = order[begin : begin + 32]
            m = len(batch)
            column = np.concatenate([np.append(texts[i][0], bins[i]) for i in batch])
            value = np.concatenate([np.append(texts[i][1], np.full(bins.shape[1], share)) for i in batch])
            counts = [len(texts[i][0]) + bins.shape[1] for i in batch]
            owner = np.repeat(np.arange(m), counts)
            vx = v[column] * value[:, None]
            begin_of = np.append(0, np.cumsum(counts)[:-1])
            total = np.add.reduceat(vx, begin_of)
            out = bias + np.bincount(owner, w[column] * value, minlength=m)
            out += 0.5 * (total**2 - np.add.reduceat(vx**2, begin_of)).sum(1)
            slope = (_logistic(out) - label[batch]) * weight[batch] / m
            used, inverse = np.unique(column, return_inverse=True)
            gw = np.bincount(inverse, slope[owner] * value) + decay * w[used]
            each = (slope[owner] * value)[:, None] * (total[owner] - vx)
            gv = np.stack([np.bincount(inverse, each[:, f]) for f in range(RANK)], axis=1) + decay * v[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += slope.sum() ** 2
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= rate * gv / np.sqrt(seen_v[used])
            bias -= rate * slope.sum() / np.sqrt(seen_b)
    return Model(cuts, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most `per_class` documents of each label; without both labels, a constant model.

    The vectors of the sample are made in tasks; these, bounded by the sample's size and `BUCKETS`,
    are what the driver learns from.
    """
    sample = training_sample(docs, labels, label, per_class)
    if sample.rows is None:
        return Model(np.zeros((0, 0)), 0.0, np.zeros(0), np.zeros((0, 0)), sample.prior)

    def work(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(3)], names=["row", "text"])
            for rows, texts in small_batches(pair):
                part = batch.slice(rows[0].as_py(), len(rows))
                t = Texts(texts)
                owner, column, value = word_columns(t)
                cut = np.searchsorted(owner, np.arange(1, t.n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(3)),
                        pa.array([c.astype(np.int32) for c in np.split(column, cut)], pa.list_(pa.int32())),
                        pa.array([c.astype(np.float32) for c in np.split(value, cut)], pa.list_(pa.float32())),
                        pa.array(list(statistics(t)), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "label", "weight", "columns", "values", "statistics"],
                )

    schema = "doc_id long, label double, weight double, columns array<int>, values array<float>, statistics array<double>"
    made = sample.rows.select("doc_id", "label", "weight", "text").mapInArrow(released(work), schema)
    rows = made.toPandas().sort_values("doc_id", kind="stable")
    texts = list(zip(rows["columns"], rows["values"].map(lambda x: np.asarray(x, float)), strict=True))
    return train(texts, np.stack(rows["statistics"].to_list()), rows["label"].to_numpy(), rows["weight"].to_numpy())


def scored(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text: str = "text",
    score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """The id (or the columns `keep`) and `score` (0 to 1, higher: label 1 likelier) of every row.

    Null texts count as empty; texts without words are scored from their statistics (all zero).
    Repeated rows and null ids are scored each; other columns are not read.  With `keep`, the score's
    column is `_score`, so that it clashes with no kept column.
    """
    columns, score = (keep, "_score") if keep else ([id_column], score)
    if model.constant is not None:
        return docs.select(*columns, F.lit(float(model.constant)).alias(score))
    row = docs.select(*columns)
    schema, n = docs.select(*columns).schema.add(score, "double"), len(columns)
    at = columns.index(text) if text in columns else n  # a kept text is sent once
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        machine = Model(*broadcast.value)
        for batch in batches:
            sent = pc.fill_null(batch.column(at), "")
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), sent], names=["row", "text"])
            for rows, texts in small_batches(pair):
                t = Texts(texts)
                raw = raw_scores(machine, t.n, *word_columns(t), statistic_columns(statistics(t), machine.cuts))
                part = batch.slice(rows[0].as_py(), len(rows))
                values = [*(part.column(i) for i in range(n)), pa.array(_logistic(raw))]
                yield pa.RecordBatch.from_arrays(values, names=schema.names)

    sent = row if text in columns else docs.select(*columns, text_or_empty(text).alias("_text"))
    return sent.mapInArrow(released(work), schema)

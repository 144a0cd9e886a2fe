"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

Words are inserted into two tries, forward and reversed, whose nodes have numbers: a word of n letters
has the prefix nodes P0 .. Pn and the suffix nodes S0 .. Sn (Si is what follows the first i letters).

* Skipping letter i leaves the pair (Pi, Si+1).  Two words with that pair differ in that letter only.
* Inserting a letter before letter i leaves (Pi, Si).  A longer word with the same pair after a skip
  is the word with one letter more.

So equality of two integers replaces the comparison of words, nothing is compared approximately, and
a join over the pairs finds exactly the neighbours.  A pair names at most one word by insertion and one
word for each letter of the alphabet by skips: its groups never grow with the data.  Of a run of equal
letters only the first one is skipped for insertions, so a neighbour is met once.

Trie nodes are numbered in one pass over the words in sorted order, over range partitions: a word shares
the nodes of its common prefix with the word before it and gets new ones for the rest.  What the
first word of a partition shares with the last one before it is renamed afterwards, from one word for
each end of a partition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm import chartext as ct
from orderlens.llm.bpe import small_batches, text_or_empty
from orderlens.sources.scratch import materialize

SHORTEST, RAREST = 7, 2
DOMINANT = 10  # a form occurs at least so many times as often
DROPPED = 31  # one of so many (document, run) loses a letter
HELD_WORDS, HELD_CHARS = 100_000, 4_000_000  # words a task counts before it hands them on
SKIP, FIRST_SKIP, INSERT = 0, 1, 2


# ---- words --------------------------------------------------------------------------------------


def damaged(run: str, prefix: int) -> str:
    """The run, without one of its letters where the checksum says so; `prefix` is that of the id."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROPPED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, id_column: str, text: str, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """`word, n`: the runs of letters of all texts, counted in tasks before they are shuffled."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(batches):
        held: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for keys, texts in small_batches(batch):
                for key, one in zip(keys.to_pylist(), texts, strict=True):
                    found = Counter(runs.findall(one.encode().lower().decode()))
                    prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for run, count in found.items():
                        word = damaged(run, prefix)
                        if len(word) >= shortest:
                            held[word] += count
                            chars += len(word)
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys()), pa.array(held.values())], schema=schema)
                    held, chars = Counter(), 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys()), pa.array(held.values())], schema=schema)

    counted = df.select(F.col(id_column).cast("string").alias("id"), text_or_empty(text)).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


# ---- tries --------------------------------------------------------------------------------------


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Trie:
    """Numbers the nodes of words that come in sorted order; the root is 0, others count from `first`."""

    def __init__(self, first: int):
        self.first = first
        self.before, self.nodes = "", [0]

    def add(self, word: str) -> list[int]:
        """The word's nodes by depth; those of the prefix it shares with the word before are the same."""
        shared = common_prefix(self.before, word)
        new = len(word) - shared
        self.nodes = [*self.nodes[: shared + 1], *range(self.first, self.first + new)]
        self.first += new
        self.before = word
        return self.nodes


def _numbered(words: DataFrame, others: list[str], name: str) -> DataFrame:
    """`words` (word, others...), sorted over range partitions, written with `place` and `nodes`.

    `place` ascends with the word over all partitions.
    """
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["word", *others, "part", "place", "nodes"]
    columns = ", ".join(["word string", *(f"{c} long" for c in others), "part int, place long, nodes array<long>"])

    def work(batches):
        part = TaskContext.get().partitionId()
        place, trie = part << 33, Trie((part << 40) + 1)
        for batch in batches:
            spelled = batch.column(0).to_pylist()
            nodes = [trie.add(word) for word in spelled]
            places = pa.array(range(place, place + len(spelled)), pa.int64())
            place += len(spelled)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(spelled), pa.int32()), places, pa.array(nodes, pa.list_(pa.int64()))],
                names=names,
            )

    ordered = words.select("word", *others).repartitionByRange(parts, "word").sortWithinPartitions("word")
    return materialize(ordered.mapInArrow(work, columns), name)


def _renamed(numbered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that a partition numbered anew although the one before it had them, and their numbers.

    One word from either end of each partition is looked at, whatever the number of words.
    """
    ends = numbered.groupBy("part").agg(
        *[f(F.struct("word", "nodes")).alias(name) for f, name in ((F.min, "first"), (F.max, "last"))]
    )
    names: dict[int, int] = {}
    before, nodes = "", [0]
    for row in sorted(ends.collect()):
        word, own = row["first"]
        for depth in range(1, common_prefix(before, word) + 1):
            names[own[depth]] = nodes[depth]
        before, own = row["last"]
        nodes = [names.get(x, x) for x in own]
    keys = np.array(sorted(names), np.int64)
    return keys, np.array([names[k] for k in keys.tolist()], np.int64)


def _replaced(nodes: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, values = names
    if not len(keys):
        return nodes
    at = np.minimum(np.searchsorted(keys, nodes), len(keys) - 1)
    return np.where(keys[at] == nodes, values[at], nodes)


# ---- pairs --------------------------------------------------------------------------------------


def pairs_of(words: list[str], forward: np.ndarray, backward: np.ndarray) -> tuple[np.ndarray, ...]:
    """The node pairs of some words: (word's index, prefix node, suffix node, kind), as flat arrays.

    `forward` and `backward` hold the nodes of each word and of its reversal, len(word) + 1 each.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    index = np.repeat(np.arange(len(words)), sizes + 1)
    depth = ct.ranges(np.zeros(len(words), np.int64), sizes + 1)
    # The suffix after the first i letters has the reversed trie's node at depth len - i.
    suffix = backward[begins[index] + sizes[index] - depth]
    inside = depth < sizes[index]
    codes = ct.codes_of("".join(words))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    fresh[starts] = True
    kinds = np.where(fresh, FIRST_SKIP, SKIP)
    after = suffix[1:][inside[:-1]] if len(suffix) else suffix
    return (
        np.concatenate([index[inside], index]),
        np.concatenate([forward[inside], forward]),
        np.concatenate([after, suffix]),
        np.concatenate([kinds, np.full(len(index), INSERT)]),
    )


def _pairs(forward: DataFrame) -> DataFrame:
    """All node pairs (prefix, suffix, id, n, kind) of the numbered words."""
    turned = forward.select(F.reverse("word").alias("word"), F.col("place").alias("id"))
    backward = _numbered(turned, ["id"], "trie_backward")
    context = forward.sparkSession.sparkContext
    names = context.broadcast((_renamed(forward), _renamed(backward)))
    both = forward.select(F.col("place").alias("id"), "word", "n", F.col("nodes").alias("prefixes")).join(
        backward.select("id", F.col("nodes").alias("suffixes")), "id"
    )

    def work(batches):
        ahead, behind = names.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column(3)).to_pylist()
            for start, end in ct.groups(sizes):
                part = batch.slice(start, end - start)
                flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (part.column(3), part.column(4))]
                index, prefix, suffix, kind = pairs_of(
                    part.column(1).to_pylist(), _replaced(flat[0], ahead), _replaced(flat[1], behind)
                )
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix), pa.array(suffix), part.column(0).take(take), part.column(2).take(take), pa.array(kind, pa.int32())],
                    names=["prefix", "suffix", "id", "n", "kind"],
                )

    return both.mapInArrow(work, "prefix long, suffix long, id long, n long, kind int")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """`id, n_near, form_n, form`: how many neighbours a word has, and the most frequent one.

    In the group of a pair all skipped words are neighbours of each other, and those that skip
    first letters of runs are neighbours of the inserted word.  The two most frequent words of a
    group give every member its most frequent other one.
    """
    rank = lambda m: F.struct(m["n"].alias("n"), (-m["id"]).alias("id"))
    skips = F.filter("members", lambda m: m["kind"] != INSERT)
    grouped = (
        pairs.groupBy("prefix", "suffix")
        .agg(F.collect_list(F.struct("n", "id", "kind")).alias("members"))
        .where(F.size("members") > 1)
        .select(
            skips.alias("skips"),
            F.get(F.filter("members", lambda m: m["kind"] == INSERT), F.lit(0)).alias("inserted"),
        )
        .withColumn("top", F.slice(F.sort_array(F.transform("skips", rank), asc=False), 1, 2))
        .withColumn("firsts", F.filter("skips", lambda m: m["kind"] == FIRST_SKIP))
    )

    def skipped(m: Column) -> Column:
        first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
        other = F.when(first["id"] == -m["id"], second).otherwise(first)
        longer = (m["kind"] == FIRST_SKIP) & F.col("inserted").isNotNull()
        shorter = F.when(longer, rank(F.col("inserted")))
        return F.struct(
            m["id"].alias("id"),
            (F.size("skips") - 1 + longer.cast("int")).alias("near"),
            F.array_max(F.array(other, shorter)).alias("best"),
        )

    inserted = F.struct(
        F.col("inserted.id").alias("id"), F.size("firsts").alias("near"), F.array_max(F.transform("firsts", rank)).alias("best")
    )
    rows = F.concat(
        F.transform("skips", skipped), F.when(F.col("inserted").isNotNull(), F.array(inserted)).otherwise(F.array())
    )
    return (
        grouped.select(F.inline(rows))
        .where("near > 0")
        .groupBy("id")
        .agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
        .select("id", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.id")).alias("form"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """Links (id, to) followed to their ends, doubling the distance: every link multiplies the count
    of occurrences, so there are no circles and few steps."""
    while True:
        further = links.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        jumped = links.join(further, F.col("to") == F.col("_id"), "left").select(
            "id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")
        )
        jumped = materialize(jumped, "variant_roots")
        links = jumped.select("id", "to")
        if jumped.where("moved").isEmpty():
            return links


# ---- the operator -------------------------------------------------------------------------------


def grouped(
    df: DataFrame, id_column: str = "doc_id", text: str = "text",
    shortest: int = SHORTEST, rarest: int = RAREST, dominant: int = DOMINANT,
) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of every word.

    Words are the maximal runs of a to z, A to Z (lower-cased) and U+00C0 to U+00FF in whole texts, of at
    least `shortest` letters and `rarest` occurrences, after one of `DROPPED` runs has lost a letter.
    `form` is the most frequent neighbour if it occurs `dominant` times as often, ties to the first
    in code-point order; `root` the end of the chain of forms.  Null and empty texts have no words; a
    null id counts as empty in the checksum that drops letters; rows that repeat are counted each; an
    empty table gives an empty result; other columns are not read; words of any length are whole.
    """
    words = materialize(word_counts(df, id_column, text, shortest, rarest), "variant_words")
    numbered, near = _with_neighbours(words)
    known = numbered.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("form_n") >= dominant * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")],
    )
    known = materialize(known, "variant_forms")
    roots = _roots(known.where("form is not null").select("id", F.col("form").alias("to")))
    spelled = lambda name: numbered.select(F.col("id").alias(f"_{name}"), F.col("word").alias(name))
    led = (
        known.where("form is not null")
        .join(roots, "id")
        .withColumnRenamed("form", "_form")
        .withColumnRenamed("to", "_root")
        .join(spelled("form"), "_form")
        .join(spelled("root"), "_root")
    )
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    alone = known.where("form is null").withColumns(
        {"form": F.lit(None).cast("string"), "root": F.col("word"), "form_n": F.lit(None).cast("long")}
    )
    return led.select(*columns).unionByName(alone.select(*columns))


def _with_neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with their ids, and the neighbours by id."""
    forward = _numbered(words, ["n"], "trie_forward")
    near = materialize(_neighbours(_pairs(forward)), "variant_neighbours")
    return forward.select(F.col("place").alias("id"), "word", "n"), near

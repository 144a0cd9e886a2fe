"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed
patterns.  Words that keep company with them can reveal them even when the entity itself is gone, so
the corpus says how strongly: over all word positions, PMI(term; kind) compares how often a term
stands within `WINDOW` words of an entity of that kind with what chance would give, and IC(kind) is
the information of such a position.  PMI / IC is 1 for a term that occurs only near such entities.
In documents that hold an entity of the kind, terms above `GENERALISE` are replaced by the kind's
label, terms above `REMOVE` are removed.

Counting needs no table of all words: contexts are few, and a bit table of fixed size tells which
other occurrences of their terms have to be counted; joins on the term's hash then make it exact.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.llm import bittable
from orderlens.llm import chartext as ct
from orderlens.llm.bpe import LETTER, small_batches, text_or_empty
from orderlens.llm.textstats import Texts
from orderlens.sources.scratch import materialize

# Parameters of the disclosure rule.
WINDOW = 5
SUPPORT = 5  # different entities a term must stand near
GENERALISE, REMOVE = 0.80, 0.95

BITS = 22

# The kinds in order, and what is always personal data.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from the at signs so that long runs without one cost nothing."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            found.append(Span(0, start, domain.end()))
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def entities(text: str) -> list[Span]:
    """Personal data by the fixed patterns, by kind and start; matches that fail a test are dropped."""
    found = emails(text)
    first = _DIGIT.search(text)
    if first is None:
        return found
    begin = first.start()
    for m in _IP.finditer(text, begin):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            found.append(Span(1, *m.span()))
    for m in _CARD.finditer(text, begin):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text, max(0, begin - 1)):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(Span(3, *m.span()))
    return found


class Words(NamedTuple):
    """Letter words of some texts: places within the text, hash, and text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    owner: np.ndarray


def words_of(texts: list[str]) -> Words:
    t = Texts(texts)
    start, end, owner = t.spans(t.kind == LETTER)
    return Words(start - t.edges[owner], end - t.edges[owner], ct.slice_hashes(t.lower, start, end), owner)


def _near(words: Words, first: int, last: int, span: Span) -> np.ndarray:
    """Words first to last that stand within the window of a span, not inside it."""
    before = first + int(np.searchsorted(words.end[first:last], span.start, side="right"))
    after = first + int(np.searchsorted(words.start[first:last], span.end, side="left"))
    return np.concatenate(
        [np.arange(max(first, before - WINDOW), before), np.arange(after, min(last, after + WINDOW))]
    )


def _contexts(docs: DataFrame) -> DataFrame:
    """Words near entities, by document: kind, hash, term, and either the entity and one position
    near it, or how often the document has the term.  Rows without a kind count all words."""
    names = ["kind", "hash", "term", "entity", "near", "within"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = "kind int, hash long, term string, entity long, near long, within long"

    def work(batches):
        total = 0
        for batch in batches:
            for _, texts in small_batches(batch):
                spans_of = [entities(t) for t in texts]
                words = words_of(texts)
                total += len(words.hash)
                edge = np.searchsorted(words.owner, np.arange(len(texts) + 1))
                out = []
                for i, (text, spans) in enumerate(zip(texts, spans_of, strict=True)):
                    if not spans:
                        continue
                    nearest: dict[tuple[int, int], int] = {}
                    for s in spans:
                        value = zlib.crc32(text[s.start : s.end].encode())
                        for w in _near(words, edge[i], edge[i + 1], s).tolist():
                            nearest.setdefault((s.kind, w), value)
                    own = np.sort(words.hash[edge[i] : edge[i + 1]])
                    terms: dict[tuple[int, int], str] = {}
                    for (kind, w), value in nearest.items():
                        h = words.hash[w]
                        term = terms.setdefault(
                            (kind, int(h.view(np.int64))), text[words.start[w] : words.end[w]].lower()
                        )
                        out.append((kind, int(h.view(np.int64)), term, value, 1, 0))
                    for (kind, h), term in terms.items():
                        u = np.int64(h).view(np.uint64)
                        n = int(np.searchsorted(own, u, side="right") - np.searchsorted(own, u, side="left"))
                        out.append((kind, h, term, None, 0, n))
                if out:
                    columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        count = [None, None, None, None, total, 0]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(count, types, strict=True)], names=names)

    return docs.mapInArrow(work, schema)


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`hash, times` of at least all `terms` over all texts."""
    flags = docs.sparkSession.sparkContext.broadcast(bittable.build(terms, "hash", BITS))

    def work(batches):
        found = np.zeros(0, np.uint64)
        for batch in batches:
            for _, texts in small_batches(batch):
                hashes = words_of(texts).hash
                found = np.concatenate([found, hashes[bittable.contains(flags.value, hashes, BITS)]])
                if len(found) > 1_000_000:
                    yield counted(found)
                    found = found[:0]
        yield counted(found)

    def counted(found):
        distinct, times = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(times)], names=["hash", "times"])

    return docs.mapInArrow(work, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))


def disclosing_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """`kind, hash, term, ratio` of every term at or above `GENERALISE`.

    Counts cover all texts.  A term needs `SUPPORT` different entities near it, since a rare word
    beside a single one says nothing.  The documents that hold entities have each term a number of
    times already; terms too frequent there for the ratio need not be counted elsewhere.
    """
    docs = df.select(F.lit(0).alias("none"), text_or_empty(text))
    near = materialize(
        _contexts(docs)
        .groupBy("kind", "hash", "entity")
        .agg(F.sum("near").alias("near"), F.sum("within").alias("within"), F.min("term").alias("term"))
        .groupBy("kind", "hash")
        .agg(
            F.sum("near").alias("near"), F.sum("within").alias("within"), F.count("entity").alias("entities"),
            F.min("term").alias("term"),
        ),
        "contexts",
    )
    positions = {r["kind"]: r["n"] for r in near.groupBy("kind").agg(F.sum("near").alias("n")).collect()}
    words = float(positions.pop(None, 0))
    if not positions:
        return near.where("false").select("kind", "hash", "term", F.lit(0.0).alias("ratio"))
    by_kind = lambda f: F.create_map(*(F.lit(x) for k, n in positions.items() for x in (k, f(n))))[F.col("kind")]
    information = by_kind(lambda n: math.log2(words / n) if n < words else 1e-9)

    def ratio(times: str) -> Column:
        return F.log2(F.lit(words) * F.col("near") / (F.col(times) * by_kind(float))) / information

    candidates = materialize(
        near.where((F.col("entities") >= SUPPORT) & (ratio("within") >= GENERALISE)), "context_terms"
    )
    if candidates.isEmpty():
        return candidates.select("kind", "hash", "term", F.lit(0.0).alias("ratio"))
    return (
        candidates.join(_frequencies(docs, candidates), "hash")
        .withColumn("ratio", ratio("times"))
        .where(F.col("ratio") >= GENERALISE)
        .select("kind", "hash", "term", "ratio")
    )


SPANS = "array<struct<kind:int,start:int,end:int,ratio:double>>"


def found(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every row and `spans`: kind (a place in `KINDS`), start, end, ratio.

    Spans are in code points, by kind and start; those of the fixed patterns have no ratio, terms
    have their disclosure ratio.  Terms inside an entity are not reported again.  Null texts count as
    empty, empty texts have no spans, repeated rows are read each, an empty table gives an empty
    result; other columns are not read.
    """
    terms = materialize(disclosing_terms(df, text), "disclosing_terms")
    flags = df.sparkSession.sparkContext.broadcast(bittable.build(terms, "hash", BITS))
    schema = df.select(*keep).withColumn("fixed", F.lit(None).cast(SPANS)).withColumn(
        "maybe", F.lit(None).cast("array<struct<kind:int,start:int,end:int,hash:bigint>>")
    ).schema
    types = to_arrow_schema(schema)
    n = len(keep)

    def work(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(n)], names=["row", "text"])
            for rows, texts in small_batches(pair):
                spans = [entities(t) for t in texts]
                held = [i for i, s in enumerate(spans) if s]
                maybe: list[list[dict]] = [[] for _ in texts]
                if held and flags.value.any():
                    words = words_of([texts[i] for i in held])
                    hit = np.flatnonzero(bittable.contains(flags.value, words.hash, BITS))
                    for w in hit.tolist():
                        i = held[words.owner[w]]
                        a, b = int(words.start[w]), int(words.end[w])
                        if any(s.start < b and a < s.end for s in spans[i]):
                            continue
                        for kind in sorted({s.kind for s in spans[i]}):
                            maybe[i].append({"kind": kind, "start": a, "end": b, "hash": int(words.hash[w].view(np.int64))})
                fixed = [[{"kind": s.kind, "start": s.start, "end": s.end, "ratio": None} for s in one] for one in spans]
                part = batch.slice(rows[0].as_py(), len(rows))
                columns = [part.column(i) for i in range(n)]
                columns += [pa.array(fixed, types.field("fixed").type), pa.array(maybe, types.field("maybe").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    read = df.select(*keep, text_or_empty(text).alias("_text")).mapInArrow(work, schema)
    read = materialize(read.withColumn("_row", F.monotonically_increasing_id()), "entity_rows")
    term = F.lit(KINDS.index("term")).alias("kind")
    sure = (
        read.where(F.size("maybe") > 0)
        .select("_row", F.explode("maybe").alias("m"))
        .select("_row", "m.*")
        .join(terms, ["kind", "hash"])
        .groupBy("_row", "start", "end")  # a term near several kinds is one span, with the largest ratio
        .agg(F.max("ratio").alias("ratio"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct(term, "start", "end", "ratio"))).alias("sure"))
    )
    sure = materialize(sure, "term_spans")
    spans = F.concat("fixed", F.coalesce("sure", F.array().cast(SPANS)))
    return read.join(sure, "_row", "left").select(*keep, spans.alias("spans"))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def sanitised(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with entities replaced by their kind, terms generalised to "<related>" or removed.

    Where spans overlap, the one that starts first (then the earlier kind) is replaced.
    """
    spots = found(df, df.columns, text)

    def step(state: Column, s: Column) -> Column:
        label = F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(">"))
        label = F.when(s["ratio"] >= REMOVE, F.lit("")).when(s["ratio"] >= GENERALISE, F.lit("<related>")).otherwise(label)
        kept = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.when(fresh, s["end"]).otherwise(F.greatest(state["at"], s["end"])).alias("at"),
            F.when(fresh, F.concat(state["out"], kept, label)).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.char_length(text)))
    by_start = lambda s: F.struct(*(s[name].alias(name) for name in ("start", "kind", "end", "ratio")))
    ordered = F.array_sort(F.transform("spans", by_start))
    clean = F.when(F.size("spans") > 0, F.aggregate(ordered, begin, step, rest)).otherwise(F.col(text))
    return spots.withColumn(text, clean).select(*df.columns)

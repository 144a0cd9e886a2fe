"""Jaccard join of word n-gram sets by T-occurrence search (DivideSkip), and its components.

Two documents link when their shingle sets have Jaccard similarity of at least a bound.  Links are
found without comparing all pairs and without losing any:

1. One pass makes every document's set, a key of the whole set (equal sets are one node from here
   on), a few min-hashes, and counts by cell that tell frequent shingles from rare ones.
2. Nodes with a common min-hash are compared with the smallest node of that group only.  This links
   most groups of near copies with one comparison each; their components are known from here on.
3. Set elements are ordered: rare ones first, then by hash.  A set of n shares at least bound * n
   elements with a smaller one it links to, and 2 * bound / (1 + bound) * n with a larger one.  So the
   first n - ceil(bound * n) + T elements of the larger set and the first n - ceil(2 * bound /
   (1 + bound) * n) + T of the smaller one have T in common: the former are searched for, the latter
   are on the lists.  Shingles whose postings all lie in one component cannot add anything; a
   pre-aggregated minimum and maximum tells them, so a hot group's lists are never gathered.
4. What is left are inverted lists, cut into blocks of nodes.  A list goes once to each pair of a
   block of searching nodes and a block of candidates that it touches, and never whole to every node
   on it; all lists of a candidate meet there.  For each searching node DivideSkip finds the
   candidates of other components on T of its lists: short lists are merged with a heap that skips
   ahead, long ones are probed by binary search.
5. Candidates are compared exactly, set against set, in the same blocks: a text is sent once to
   each pair of blocks that needs it, not once for each pair of texts.

The order of elements decides how much work there is, never what is found: the tables that speed
it up are bounded, and beyond their size joins do the same.  Sets hold 64-bit hashes of shingles; two
texts link wrongly, or not, only where hashes of different shingles agree by chance.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm import cells
from orderlens.llm import chartext as ct
from orderlens.llm.bpe import small_batches, text_or_empty
from orderlens.llm.components import components
from orderlens.llm.workers import released
from orderlens.sources.scratch import materialize

MINHASHES = 3
OCCURRENCES = 4  # T: common rare shingles that make a candidate
WORD_CHARS = 6  # a guess, for the number of cells only
CELLS = 2  # for each shingle, within the bounds of `cells`
POSTING_CELLS = 8  # for each posting
CROSSING_CELLS = 16  # for each shingle that meets several components
NODE_BLOCK = 256  # nodes of a block
BROADCAST_IDS = 2_000_000  # 16 MB


class Bound(NamedTuple):
    """Similarity of at least `top` / `bottom`."""

    top: int = 80
    bottom: int = 100

    def least(self, n):
        """Overlap that a set of n elements has with any set it links to."""
        return -(-self.top * n // self.bottom)

    def holds(self, common: int, a: int, b: int) -> bool:
        return self.bottom * common >= self.top * (a + b - common)

    def occurrences(self, n):
        return np.minimum(OCCURRENCES, self.least(n))

    def prefix(self, n):
        """How many first elements of a set of n are searched for in smaller sets."""
        return np.minimum(n, n - self.least(n) + self.occurrences(n))

    def indexed(self, n):
        """How many of them larger sets must be able to find: with those it shares more."""
        common = -(-2 * self.top * n // (self.bottom + self.top))
        return np.minimum(n, n - common + self.occurrences(n))


# ---- sets ---------------------------------------------------------------------------------------


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs without ASCII white space, A to Z in lower case.  A text with fewer words than a
    shingle has its whole sequence as the only one; without words the set is empty.
    """
    codes = ct.codes_of("".join(texts))
    edges = np.append(0, np.cumsum([len(t) for t in texts]))
    letters = codes + np.uint32(32) * ((codes >= 65) & (codes <= 90))
    starts, ends, owner = ct.spans((codes != 32) & ((codes < 9) | (codes > 13)), edges)
    word = ct.slice_hashes(letters, starts, ends)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    per_text = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    at = ct.ranges(first, per_text)
    length = np.minimum(np.repeat(counts, per_text), words)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(words):
        inside = length > j
        hashes[inside] = ct.mix(hashes[inside]) + word[at[inside] + j]
    hashes = ct.mix(hashes ^ length.astype(np.uint64))
    sets, begin = [], 0
    for n in per_text.tolist():
        one = np.sort(hashes[begin : begin + n])
        begin += n
        sets.append(one[np.append(True, one[1:] != one[:-1])] if n else one)
    return sets


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets: the smaller one is probed in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _key(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def _described(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Pass 1: a row for each document, and the cells of its task's shingles."""
    seeds = ct.mix(np.arange(1, MINHASHES + 1, dtype=np.uint64))
    names = ["doc_id", "n", "set_key", "hashes", "part", "packed"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def batch_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], schema=schema)

    def messages(found: list[tuple[int, bytes]]):
        none = [None] * len(found)
        return batch_of(none, none, none, none, [p for p, _ in found], [m for _, m in found])

    def work(batches):
        gatherer = cells.Gatherer(bits)
        for batch in batches:
            for ids, texts in small_batches(batch):
                sets = shingle_sets(texts, words)
                flat = np.concatenate(sets)
                if found := gatherer.add(flat):
                    yield messages(found)
                keys = [_key(s) if len(s) else None for s in sets]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                least = np.zeros((len(sets), MINHASHES), np.uint64)
                if len(full):
                    begins = (np.cumsum(sizes) - sizes)[full]
                    for k, seed in enumerate(seeds):
                        least[full, k] = np.minimum.reduceat(ct.mix(flat ^ seed), begins)
                none = [None] * len(sets)
                yield batch_of(ids, sizes, keys, list(least.view(np.int64)), none, none)
        if found := gatherer.rest():
            yield messages(found)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text")).mapInArrow(
        released(work), "doc_id long, n long, set_key binary, hashes array<long>, part int, packed binary"
    )
    return materialize(made, "shingle_sets")


def _frequent_from(shingles: int, bits: int) -> int:
    """Counts of a cell that chance alone does not give: several deviations above the mean."""
    mean = shingles / (1 << bits)
    return int(np.ceil(mean + 3 * np.sqrt(mean) + 3))


def _rare_first(one: np.ndarray, flags: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n elements of a sorted set in one order for all sets: rare ones, then by hash."""
    often = cells.contains(flags, one, bits)
    rare = one[~often][:n]
    return rare if len(rare) == n else np.concatenate([rare, one[often][: n - len(rare)]])


# ---- comparing ----------------------------------------------------------------------------------


def _linked(pairs: DataFrame, docs: DataFrame, words: int, bound: Bound) -> DataFrame:
    """The pairs (a, b) of documents whose sets reach the bound, compared set against set."""

    def work(batches):
        for batch in batches:
            both = [pa.RecordBatch.from_arrays([batch.column(0), batch.column(k)], names=["id", "text"]) for k in (2, 3)]
            # The same rows are cut alike by the longer of their two texts.
            sizes = np.maximum(*(np.asarray(pc.binary_length(b.column(1)), np.int64) for b in both)).tolist()
            for start, end in ct.groups(sizes):
                part = batch.slice(start, end - start)
                left, right = (shingle_sets(part.column(k).to_pylist(), words) for k in (2, 3))
                keep = [bound.holds(overlap(x, y), len(x), len(y)) for x, y in zip(left, right, strict=True)]
                kept = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    left, right = (_texts(docs, pairs.select(c)).withColumnRenamed("text", name) for c, name in (("a", "left"), ("b", "right")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialize(both.mapInArrow(released(work), "a long, b long").distinct(), "links")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents in a column of ids, under its name.

    Few ids are broadcast, so that other texts are left out where they are read; beyond
    `BROADCAST_IDS` all texts go into the join that follows, which leaves them out as well.
    """
    [name] = ids.columns
    text = docs.select(F.col("doc_id").cast("long").alias(name), text_or_empty("text"))
    known = ids.distinct()
    return text.join(F.broadcast(known), name, "left_semi") if known.count() <= BROADCAST_IDS else text


def _near_minhash(nodes: DataFrame, bound: Bound) -> DataFrame:
    """Pairs of each node with the smallest node that shares one of its min-hashes."""
    spread = nodes.select("node", "n", F.posexplode("hashes").alias("k", "hash"))
    smallest = (
        spread.groupBy("k", "hash")
        .agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("size"))
        .where("size > 1")
        .select("k", "hash", F.col("least.node").alias("a"), F.col("least.n").alias("n_a"))
    )
    smallest = materialize(smallest, "minhash_groups")
    near = spread.join(smallest, ["k", "hash"]).where("a <> node")
    fits = (bound.bottom * F.least("n", "n_a") >= bound.top * F.greatest("n", "n_a"))
    return materialize(near.where(fits).select("a", F.col("node").alias("b")).distinct(), "minhash_pairs")


# ---- T-occurrence search ------------------------------------------------------------------------


def divide_skip(lists: list[list[int]], least: int) -> list[int]:
    """The values that occur on at least `least` of the ascending lists.

    The longest lists, fewer than `least`, are set aside; a value must then be on the required rest
    of the short ones.  A heap merges these and skips: if the smallest value occurs too rarely, the
    lists ahead of the threshold move on by binary search to the next value that still can.  Every
    value found is looked up in the long lists by binary search.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return []
    aside = min(least - 1, sum(len(x) > 64 for x in lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need = least - aside
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            hits = len(popped)
            for x in long:
                at = bisect_left(x, value)
                hits += at < len(x) and x[at] == value
            if hits >= least:
                found.append(value)
            following = value + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            following = heap[0][0]  # smaller values cannot occur often enough
        for _, i, at in popped:
            at = bisect_left(short[i], following, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return found


def _heads(docs: DataFrame, nodes: DataFrame, flags: np.ndarray, bits: int, words: int, bound: Bound) -> DataFrame:
    """Pass 2: `node, root, n` and the elements that every node posts, as packed 64-bit hashes.

    Heads, not texts, are shuffled to their nodes.
    """
    rare = docs.sparkSession.sparkContext.broadcast(flags)
    schema = pa.schema([("set_key", pa.binary()), ("head", pa.binary())])

    def first(batches):
        for batch in batches:
            for _, texts in small_batches(batch):
                sets = [s for s in shingle_sets(texts, words) if len(s)]
                heads = [_rare_first(s, rare.value, bits, int(bound.prefix(len(s)))).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_key(s) for s in sets], pa.binary()), pa.array(heads, pa.binary())], schema=schema
                )

    known = docs.where("doc_id is not null").select("doc_id", text_or_empty("text"))
    heads = known.mapInArrow(released(first), "set_key binary, head binary").groupBy("set_key").agg(F.first("head").alias("head"))
    return materialize(heads.join(nodes, "set_key").select("node", "root", "n", "head"), "heads")


def _lists(heads: DataFrame, bound: Bound) -> DataFrame:
    """Inverted lists of the shingles that meet several components, cut into blocks of nodes.

    Rows: shingle, block, nodes, roots, sizes, listed (arrays in ascending order of (size, node)).
    """

    def post(columns):
        def work(batches):
            for batch in batches:
                counts = np.asarray(pc.binary_length(batch.column(3)), np.int64) // 8
                for start, end in ct.groups(counts.tolist()):
                    part = batch.slice(start, end - start)
                    flat = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                    size = counts[start:end]
                    take = np.repeat(np.arange(part.num_rows), size)
                    place = ct.ranges(np.zeros(len(size), np.int64), size)
                    listed = place < bound.indexed(part.column(2).to_numpy(zero_copy_only=False))[take]
                    yield from columns(flat, part, pa.array(take), listed)

        return work

    total = heads.agg(F.sum(F.octet_length("head") / 8).cast("long")).first()[0] or 0
    met_bits = cells.bits_for(total, POSTING_CELLS)
    # What is posted once, as most of it, cannot cross components: it goes before the shuffle.
    met_twice = heads.sparkSession.sparkContext.broadcast(
        cells.frequent(heads.mapInArrow(cells.gathered(lambda batch: _flat_heads(batch, 3), met_bits), cells.MESSAGE), met_bits, 2)
    )

    def narrow(flat, part, take, listed):
        kept = np.flatnonzero(cells.contains(met_twice.value, flat.view(np.uint64), met_bits))
        flat, take, listed = flat[kept], take.take(pa.array(kept)), listed[kept]
        yield pa.RecordBatch.from_arrays([pa.array(flat), part.column(1).take(take), pa.array(listed)], names=["shingle", "root", "listed"])

    # A shuffle of (shingle, root, listed) alone: minimum and maximum are made behind it.
    met = heads.mapInArrow(released(post(narrow)), "shingle long, root long, listed boolean").repartition(F.col("shingle"))
    useful = F.min("root") < F.max("root")
    crossing = met.groupBy("shingle").agg((useful & F.bool_or("listed")).alias("useful")).where("useful").select("shingle")
    crossing = materialize(crossing, "crossing")
    bits = cells.bits_for(crossing.count(), CROSSING_CELLS)
    flags = heads.sparkSession.sparkContext.broadcast(cells.present(crossing, bits))

    def likely(flat, part, take, listed):
        kept = np.flatnonzero(cells.contains(flags.value, flat.view(np.uint64), bits))
        take = take.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat[kept]), *(part.column(k).take(take) for k in range(3)), pa.array(listed[kept])],
            names=["shingle", "node", "root", "n", "listed"],
        )

    # Most postings go before anything is shuffled; the join makes it exact.
    posted = heads.mapInArrow(released(post(likely)), "shingle long, node long, root long, n long, listed boolean")
    kept = materialize(posted.join(crossing, "shingle"), "postings")
    blocks = max(1, -(-kept.select("node").distinct().count() // NODE_BLOCK))
    member = F.struct("n", "node", "root", "listed")
    lists = kept.groupBy("shingle", _block_of("node", blocks).alias("block")).agg(F.array_sort(F.collect_set(member)).alias("of"))
    arrays = [F.col(f"of.{field}").alias(name) for field, name in _ARRAYS]
    return materialize(lists.select("shingle", "block", *arrays), "inverted_lists")


def _flat_heads(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for one in batch.column(column).to_pylist():
        yield np.frombuffer(one, np.uint64)


_ARRAYS = (("node", "nodes"), ("root", "roots"), ("n", "sizes"), ("listed", "listed"))


def _candidates(lists: DataFrame, bound: Bound) -> DataFrame:
    """For each node the smaller ones of other components that share T rare shingles with it, by
    blocks: `qb` and `cb` are those of the node and of its candidates."""
    fields = [name for _, name in _ARRAYS[:3]]
    of = F.arrays_zip(*[name for _, name in _ARRAYS])
    only = F.filter(of, lambda m: m["listed"])
    searching = lists.select("shingle", F.col("block").alias("qb"), *[F.col(name).alias(f"qb_{name}") for name in fields])
    listed = lists.select("shingle", F.col("block").alias("cb"), only.alias("on")).where(F.size("on") > 0)
    listed = listed.select("shingle", "cb", *[F.col(f"on.{name}").alias(f"cb_{name}") for name in fields])
    ends = lambda column: (F.get(column, F.lit(0)), F.element_at(column, F.lit(-1)))
    (q_low, q_high), (c_low, c_high) = ends(F.col("qb_sizes")), ends(F.col("cb_sizes"))
    roots = F.concat("qb_roots", "cb_roots")
    useful = (
        (c_low <= q_high) & (bound.bottom * c_high >= bound.top * q_low) & (F.array_min(roots) < F.array_max(roots))
    )
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        searching.join(listed, "shingle").where(useful).drop("shingle")
        .repartition(parts, "qb", "cb").sortWithinPartitions("qb", "cb")
    )
    schema = pa.schema([("qb", pa.int32()), ("cb", pa.int32()), ("node", pa.int64()), ("candidates", pa.list_(pa.int64()))])

    def work(batches):
        for (qb, cb), rows in _grouped(batches, ["qb", "cb"]):
            found = list(search_block(rows, bound))
            if found:
                size = len(found)
                values = [[qb] * size, [cb] * size, [q for q, _ in found], [c for _, c in found]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    order = ["qb", "cb", *(f"{block}_{name}" for block in ("qb", "cb") for name in fields)]
    return materialize(met.select(*order).mapInArrow(released(work), "qb int, cb int, node long, candidates array<long>"), "candidates")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of sorted batches by the values of the first columns, which are dropped."""
    waiting: list[tuple] = []
    last = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, row in zip(zip(*columns[: len(keys)], strict=True), zip(*columns[len(keys) :], strict=True), strict=True):
            if waiting and key != last:
                yield last, waiting
                waiting = []
            last = key
            waiting.append(row)
    if waiting:
        yield last, waiting


def search_block(rows: list[tuple], bound: Bound) -> Iterator[tuple[int, list[int]]]:
    """Each searching node of a block with its candidates in another (or the same) block.

    A row is a shingle's list in both blocks: nodes, roots and sizes, twice.  A node is searched once
    for each of its sizes, since rows that repeat an id are one document with several sets.
    """
    asked: dict[tuple[int, int, int], list[tuple]] = {}
    for q_nodes, q_roots, q_sizes, *members in rows:
        for query in zip(q_nodes, q_roots, q_sizes, strict=True):
            asked.setdefault(query, []).append(members)
    for (node, root, n), members in asked.items():
        # A partner has at least least(n) elements, so this holds for every pair.
        need = int(min(bound.occurrences(n), bound.occurrences(bound.least(n))))
        if len(members) < need:
            continue
        lists = [
            sorted(c for c, r, m in zip(*one, strict=True) if r != root and (m, c) < (n, node) and bound.bottom * m >= bound.top * n)
            for one in members
        ]
        if found := divide_skip(lists, need):
            yield node, found


def _block_of(node: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


def _linked_in_blocks(candidates: DataFrame, docs: DataFrame, words: int, bound: Bound) -> DataFrame:
    """Links among candidates, compared set against set; pairs that links of the same pair of blocks
    connect already are skipped."""
    sought = (
        candidates.groupBy("qb", "cb")
        .agg(F.array_distinct(F.flatten(F.collect_list("candidates"))).alias("nodes"))
        .select("qb", "cb", F.explode("nodes").alias("node"), F.lit(None).cast("array<long>").alias("candidates"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = materialize(candidates.unionByName(sought), "compared_nodes")
    rows = (
        wanted.join(_texts(docs, wanted.select("node")), "node")
        .select("qb", "cb", "node", "candidates", "text")
        .repartition(parts, "qb", "cb")
        .sortWithinPartitions("qb", "cb")
    )

    def compared(group: list[tuple]) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        sets = shingle_sets([g[3] for g in group], words)
        begin = 0
        while begin < len(group):
            end = begin
            by_node: dict[int, list[np.ndarray]] = {}
            while end < len(group) and group[end][0] == group[begin][0]:
                by_node.setdefault(group[end][1], []).append(sets[end])
                end += 1
            parent = {n: n for n in by_node}

            def find(n):
                while parent[n] != n:
                    parent[n] = n = parent[parent[n]]
                return n

            for _, query, others, _ in group[begin:end]:
                for other in others or ():
                    if find(query) == find(other):
                        continue
                    # Rows that repeat an id are one document with several texts.
                    if any(
                        bound.holds(overlap(x, y), len(x), len(y))
                        for x in by_node[query] for y in by_node.get(other, ())
                    ):
                        parent[find(query)] = find(other)
                        links.append((query, other))
            begin = end
        return links

    def work(batches):
        waiting: list[tuple] = []
        size = 0

        def flush(count):
            links = compared(waiting[:count])
            del waiting[:count]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, node, others, body in zip(keys, *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if size > 3 * ct.CHUNK_CHARS and waiting[-1][0] != key:
                    yield flush(len(waiting))
                    size = 0
                waiting.append((key, node, others, body))
                size += len(body)
        if waiting:
            yield flush(len(waiting))

    return materialize(rows.mapInArrow(released(work), "a long, b long"), "links")


# ---- the join -----------------------------------------------------------------------------------


def joined(docs: DataFrame, words: int = 5, bound: Bound = Bound()) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row.

    `component_id` is the smallest id reachable by links, the row's own included.  Null and empty
    texts and texts without words have no shingles and link with nothing.  Rows without an id link
    with nothing and have no component; rows that repeat an id are one document, all of whose texts
    count, and have one component.  Texts of any length count whole.  An empty table gives an empty
    result; other columns are not read.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = cells.bits_for(chars // WORD_CHARS, CELLS)
    described = _described(docs, words, bits)
    rows = described.where("part is null")
    linkable = rows.where("n > 0 and doc_id is not null")
    nodes = linkable.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("hashes").alias("hashes")
    )
    nodes = materialize(nodes, "set_nodes")
    near = _linked(_near_minhash(nodes, bound), docs, words, bound).unionByName(_repeated(linkable, nodes))
    grouped = components(near)
    known = nodes.drop("hashes").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    messages = described.where("part is not null").select("part", "packed")
    flags = cells.frequent(messages, bits, _frequent_from(shingles, bits))
    lists = _lists(_heads(docs, materialize(known, "known_roots"), flags, bits, words, bound), bound)
    links = near.unionByName(_linked_in_blocks(_candidates(lists, bound), docs, words, bound))
    roots = nodes.select("set_key", "node").join(components(links), "node", "left")
    roots = materialize(roots.select("set_key", F.coalesce("root", "node").alias("root")), "set_roots")
    linked = rows.where("n > 0").join(roots, "set_key").select("doc_id", "n", "root")
    # A row without shingles whose id has another row with some.
    empty = rows.where("n = 0").select("doc_id", "n")
    ids = empty.select("doc_id").distinct()
    others = linkable.select("doc_id", "set_key").join(ids, "doc_id").join(roots, "set_key")
    others = others.groupBy("doc_id").agg(F.min("root").alias("root"))
    return linked.unionByName(empty.join(others, "doc_id", "left")).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )


def _repeated(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between an id that several sets have and the nodes of those sets."""
    several = (
        rows.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high")
    )
    several = materialize(several.select("doc_id"), "repeated_ids")
    of = rows.join(several, "doc_id").select("doc_id", "set_key").distinct()
    return materialize(of.join(nodes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "id_links")

"""Sharding along a Hilbert curve over metadata, in DataFrame operations only.

Every metadata dimension is cut into cells of about equal numbers of rows (quantiles; strings by
their first differing bytes, so that their order is kept).  A row's cells are a point, and its place
on the Hilbert curve through all points is the sort order: neighbours on the curve are near in every
dimension at once, so that a run of it has narrow ranges of all of them and a reader can skip it by
any.  Runs are cut so that shards hold equal numbers of rows.

Rows are sorted by range partitions, not in one task: each partition numbers its own rows, and the
partitions' counts (one number each) shift them.  Equal texts with equal metadata are neighbours;
copies with other metadata stay with those, since one stray row would widen a shard's ranges.  A hot
group is cut like any other run: ids tell its rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.scratch import materialize

BITS = 5
ACCURACY = 1000


def _numbers(df: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """Each dimension as a number in its own order; nulls stay null.

    Strings become the seven bytes after the prefix that all values share.
    """
    strings = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    both = (("low", F.min), ("high", F.max))
    wanted = [f(F.col(d)).alias(f"{n}{i}") for i, d in enumerate(strings) for n, f in both]
    ends = df.agg(*wanted).first() if wanted else None
    made = []
    for d in dimensions:
        if d not in strings:
            made.append(F.col(d).cast("double"))
            continue
        low, high = ((ends[f"{n}{strings.index(d)}"] or "").encode() for n in ("low", "high"))
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        tail = F.substring(F.encode(d, "utf-8"), shared + 1, 7)
        made.append(F.conv(F.rpad(F.hex(tail), 14, "0"), 16, 10).cast("double"))
    return made


def cells(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> list[Column]:
    """The cell of each dimension, 0 to 2**bits - 1; nulls are in cell 0."""
    numbers = _numbers(df, dimensions)
    shares = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(
        *(F.percentile_approx(n, F.array(*map(F.lit, shares)), ACCURACY).alias(f"c{i}") for i, n in enumerate(numbers))
    ).first()
    made = []
    for i, n in enumerate(numbers):
        values = sorted(cuts[f"c{i}"] or [])
        if not values:
            made.append(F.lit(0))
            continue
        made.append(F.size(F.filter(F.array(*map(F.lit, values)), _below(n))))
    return [F.when(n.isNull(), F.lit(0)).otherwise(m).cast("int") for n, m in zip(numbers, made, strict=True)]


def _below(number: Column):
    return lambda edge: edge < number


def hilbert_index(point: Column, dimensions: int, bits: int = BITS) -> Column:
    """The place on the Hilbert curve of `point`, an array of cells.

    From the highest bit down, each axis flips or swaps the lower bits of the first (the curve's
    turns); a Gray code over the axes and the interleaved bits then give the index.
    """
    steps = F.array(
        *(
            F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
            for b in range(bits - 1, 0, -1)
            for i in range(dimensions)
        )
    )

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - F.lit(1)
        flips = F.get(x, step["i"]).bitwiseAND(step["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, step["i"])).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(flips, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    # For the first axis the swap is with itself: nothing changes there.
    turned = F.aggregate(steps, point, turn) if bits > 1 else point
    lower = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))).cast("array<int>")
    picks = F.array(
        *(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dimensions))
    )

    def gray(x: Column) -> Column:
        """Every axis takes the exclusive or of all axes up to it."""
        return F.transform(
            x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b))
        )

    def flip(x: Column) -> Column:
        last = F.get(x, F.lit(dimensions - 1))
        return F.aggregate(
            lower, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )

    def index(x: Column) -> Column:
        flipped = _let(flip(x), lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))
        bit = lambda axes, p: F.call_function("shiftright", F.get(axes, p["i"]), p["b"]).bitwiseAND(1)
        return _let(
            flipped, lambda axes: F.aggregate(picks, F.lit(0).cast("long"), lambda a, p: a * 2 + bit(axes, p))
        )

    return _let(turned, lambda x: _let(gray(x), index))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sharded(
    df: DataFrame,
    dimensions: Sequence[str],
    shards: int,
    bits: int = BITS,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each row: id, `size`, `text_crc32`, `curve`, `shard` and `slot`.

    `size` is the text's UTF-8 bytes plus 8; `slot` counts from 0 within the shard in the order of
    the curve; shards differ by one row at most, the first ones hold the extra rows.  Null texts count
    as empty, null dimensions lie in the first cell, rows without an id sort first, repeated rows
    each have their own slot; an empty table gives an empty result.  Other columns are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = df.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(whole) + 8).cast("long").alias("size"),
        F.crc32(F.encode(whole, "utf-8")).alias("text_crc32"),
        F.xxhash64(whole, F.octet_length(whole)).alias("_text"),
        hilbert_index(F.array(*cells(df, dimensions, bits)), len(dimensions), bits).alias("curve"),
    )
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", "_text", "_id", "size"]
    ordered = materialize(
        row.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "curve_order",
    )
    part = F.shiftright("_place", 33).cast("int")
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for c in counts:  # one number for each range partition
        before[c["part"]] = total
        total += c["n"]
    shifts = F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)))
    number = F.get(shifts, part) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    size, extra = divmod(total, shards)
    wide = extra * (size + 1)
    shard = F.when(F.col("_n") < wide, F.floor(F.col("_n") / (size + 1)))
    slot = F.when(F.col("_n") < wide, F.col("_n") % (size + 1))
    if size:
        shard = shard.otherwise(extra + F.floor((F.col("_n") - wide) / size))
        slot = slot.otherwise((F.col("_n") - wide) % size)
    return ordered.withColumn("_n", number).select(
        F.col("_id").alias(id_column), "size", "text_crc32", "curve",
        shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
    )


def write_shards(
    df: DataFrame, dimensions: Sequence[str], shards: int, path: str, bits: int = BITS, text: str = "text"
) -> None:
    """Write the rows as Parquet, one folder `shard=` for each shard, in slot order.

    Rows are numbered where they are written first, so null and repeated ids lose or gain none; a
    column that is called `shard` already is not written twice: it must be renamed before.
    """
    if "shard" in df.columns:
        raise ValueError("the folders of shards need the name 'shard', which a column has")
    number, slot = (next(n for n in (f"{name}{i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("_row", "_slot"))
    rows = materialize(df.withColumn(number, F.monotonically_increasing_id()), "shard_rows")
    places = sharded(rows, dimensions, shards, bits, number, text).select(number, "shard", F.col("slot").alias(slot))
    (
        rows.join(places, number)
        .repartition("shard")
        .sortWithinPartitions("shard", slot)
        .drop(number, slot)
        .write.partitionBy("shard")
        .parquet(path)
    )

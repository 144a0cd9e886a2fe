"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

A token of twenty or more characters that mixes kinds of characters gets an encoding (hexadecimal,
base32, base36, mixed letters, base62, base64) by the alphabet it keeps to.  Keys are uniform draws
from their alphabet, names and words are not, so each token is tested against "drawn at random":
chi-squared over the alphabet and over its classes, Wald-Wolfowitz runs about the alphabet's middle,
and serial correlation; four times the smallest p value is the token's.

All tokens of the corpus are judged together by a weighted Benjamini-Hochberg rule: a token's weight
is the mean length over its length, at most one, since longer tokens can be told from random ones at
smaller levels.  So no length is rejected at more than the level, and long keys at less.  Tokens
rejected are structured (the share of real keys among them is what the level controls); the others
are reported.  P values count on a fixed grid, so that the rule needs only a
table of bounded size.  Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 0.05
GRID, GRID_END = 20, 400  # steps for each power of ten, and the last step

# The patterns that are always reported, in the order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RUNS = (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9]{20,}={0,2}")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encodings: name, pattern, and the classes that make up the alphabet; the first that fits counts.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", (DIGITS, "abcdef")),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", (DIGITS, "ABCDEF")),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", (UPPER, "234567")),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", (DIGITS, LOWER)),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", (DIGITS, UPPER)),
    ("letters", r"^(?=.*[a-z])(?=.+[A-Z].*[A-Z].*[A-Z])[A-Za-z]+$", (UPPER, LOWER)),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", (UPPER, LOWER, DIGITS)),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", (UPPER, LOWER, DIGITS, "+/")),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", (UPPER, LOWER, DIGITS, "-_")),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end (code points) and the group's value of every match, leftmost and not overlapping.

    The parts between matches and the matches themselves alternate, so their lengths add up to the
    places.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        joined = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("all"), groups.alias("value"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["all"])
            span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(joined, begin, step, lambda s: s["out"])).otherwise(
            F.array().cast(kind)
        )

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns by kind; matches that are too short are dropped."""
    long = lambda n: lambda s: F.char_length(s["value"]) >= n
    # A run of hexadecimal digits is one match, so shorter runs need not be found at all.
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX[:-1] + f"{{{LEAST['hex']},}}", 0)}
    return {k: F.filter(matches(text, p, g), long(LEAST[k])) for k, (p, g) in patterns.items()}


# ---- the battery --------------------------------------------------------------------------------


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to a relative 1.2e-7 (Chebyshev fit of erfc)."""
    # Coefficients of the fit, from the constant term up.
    fit = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277,
    )

    def at(x: Column) -> Column:
        t = 1 / (1 + 0.5 * F.abs(x))
        tail = _let(t, lambda t: t * F.exp(-x * x + reduce(lambda acc, c: acc * t + c, reversed(fit[:-1]), F.lit(fit[-1]))))
        return F.when(x >= 0, tail).otherwise(2 - tail) / 2

    return _let(z / math.sqrt(2), at)


def _chi_squared(x: Column, df: int) -> Column:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    v = 2 / (9 * df)
    return upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / math.sqrt(v))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _tests(index: Column, classes: tuple[str, ...]) -> Column:
    """The battery's p value of a token; `index` holds its symbols' places in the alphabet."""
    size = sum(map(len, classes))
    n = F.size(index).cast("double")
    edges = [0]
    for c in classes:
        edges.append(edges[-1] + len(c))
    squares = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda a: F.pow(F.size(F.filter(index, lambda x: x == a)).cast("double"), F.lit(2.0)),
    )
    uniform = _chi_squared(_total(squares) * size / n - n, size - 1)
    by_class = sum(
        F.pow(
            F.size(_between(index, low, high))
            - n * ((high - low) / size),
            F.lit(2.0),
        )
        / (n * ((high - low) / size))
        for low, high in zip(edges, edges[1:])
    )
    classes_even = _chi_squared(by_class, len(classes) - 1)
    # Runs about the middle of the alphabet.
    high = F.size(F.filter(index, lambda x: x >= size // 2)).cast("double")
    low = n - high
    later = F.slice(index, F.lit(2), F.size(index) - 1)
    earlier = F.slice(index, F.lit(1), F.size(index) - 1)
    changes = F.size(
        F.filter(
            F.zip_with(earlier, later, lambda a, b: (a >= size // 2) != (b >= size // 2)), lambda x: x
        )
    )
    expected = 2 * high * low / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when((high == 0) | (low == 0) | (spread <= 0), F.lit(0.0)).otherwise(
        2 * upper_tail(F.abs(changes + 1 - expected) / F.sqrt(spread))
    )
    # Serial correlation at distance one.
    mean = _total(F.transform(index, lambda x: x.cast("double"))) / n
    serial = _let(
        mean,
        lambda m: _let(
            _total(F.transform(index, lambda x: (x - m) * (x - m))),
            lambda v: F.when(v <= 0, F.lit(0.0)).otherwise(
                2
                * upper_tail(
                    F.abs(_total(F.zip_with(earlier, later, lambda a, b: (a - m) * (b - m))) / v + 1 / n) * F.sqrt(n)
                )
            ),
        ),
    )
    return F.least(F.lit(1.0), 4 * F.least(uniform, classes_even, runs, serial))


def _between(index: Column, low: int, high: int) -> Column:
    return F.filter(index, lambda x: (x >= low) & (x < high))


def p_value(token: Column) -> Column:
    """The battery's p value under the token's encoding; null where no encoding fits."""
    made = None
    bare = F.regexp_replace(token, "=+$", "")
    for _, pattern, classes in ENCODINGS:
        value = _let(_index(bare, "".join(classes)), _with(classes))
        fits = token.rlike(pattern)
        made = F.when(fits, value) if made is None else made.when(fits, value)
    return made


def _index(token: Column, alphabet: str) -> Column:
    """Places of the token's characters in the alphabet, from 0."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def _with(classes: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda index: _tests(index, classes)


def _pieces(token: Column) -> Column:
    """Spans to test in a token: the whole where an encoding fits, otherwise its long runs of each alphabet."""
    whole = F.struct(F.lit(0).alias("start"), F.char_length(token).alias("end"), token.alias("value"))
    fits = reduce(Column.__or__, (token.rlike(pattern) for _, pattern, _ in ENCODINGS))
    runs = F.array_distinct(F.concat(*(matches(token, pattern) for pattern in RUNS)))
    return F.when(fits, F.array(whole)).otherwise(runs)


def tokens(text: Column) -> Column:
    """Long tokens with an encoding: start, end, grid step of the p value, step of the length.

    A token that no encoding fits (a key behind a path, a name or a line of dashes) is cut into its
    runs of the two base64 alphabets and of letters and digits; those of twenty or more characters
    with an encoding count as tokens, and may overlap.
    """
    kind = "array<struct<start:int,end:int,step:int,size:int>>"

    def judged(s: Column) -> Column:
        on_grid = lambda p: F.least(F.lit(GRID_END), F.floor(-GRID * F.log10(F.greatest(p, F.lit(1e-300))))).cast("int")
        # greatest() and least() skip nulls.
        step = _let(p_value(s["value"]), lambda p: F.when(p.isNotNull(), on_grid(p)))
        size = F.floor(F.log2((s["end"] - s["start"]).cast("double")) * 2).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), step.alias("step"), size.alias("size"))

    def moved(token: Column) -> Column:
        return F.transform(
            _pieces(token["value"]),
            lambda s: F.struct(
                (token["start"] + s["start"]).alias("start"), (token["start"] + s["end"]).alias("end"), s["value"].alias("value")
            ),
        )

    found = F.transform(F.flatten(F.transform(matches(text, TOKEN), moved)), judged)
    return F.filter(found, lambda t: t["step"].isNotNull()).cast(kind)


def thresholds(df: DataFrame, text: str = "text", level: float = LEVEL) -> dict[int, int]:
    """For each step of the length, the step from which a token counts as structured.

    One pass over all texts counts tokens by p value and length (a table of bounded size); the rule
    is then worked out on those counts.  A p value counts as the upper end of its step.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = (
        df.select(F.explode(tokens(whole)).alias("t"))
        .groupBy(F.col("t.step").alias("step"), F.col("t.size").alias("size"))
        .count()
        .collect()
    )
    if not counts:
        return {}
    length = {r["size"]: 2 ** (r["size"] / 2) for r in counts}
    total = sum(r["count"] for r in counts)
    mean = sum(length[r["size"]] * r["count"] for r in counts) / total
    weight = {size: min(1.0, mean / n) for size, n in length.items()}
    weighted = sorted((10 ** (-r["step"] / GRID) / weight[r["size"]], r["count"]) for r in counts)
    cut, seen = 0.0, 0
    for p, n in weighted:
        seen += n
        if p <= level * seen / total:
            cut = p
    # The smallest step whose weighted p value is within the cut; none if nothing is rejected.
    return {
        size: math.ceil(-GRID * math.log10(cut * w) - 1e-9) if cut > 0 else GRID_END + 1
        for size, w in weight.items()
    }


def scanned(df: DataFrame, text: str = "text", level: float = LEVEL) -> DataFrame:
    """All columns of `df` and `_spans`: kind, start and end (code points) of every secret.

    Spans are ordered by start, then kind.  A random token that overlaps a fixed pattern's span is
    not reported again, nor is one within another.  Null and empty texts have no spans; repeated rows are scanned each; an empty
    table gives an empty result; columns of the table named `_spans` are not allowed.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    limits = thresholds(df, text, level)
    base = base_spans(whole)
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def named(spans: Column, name: str) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(name)).alias("rank"),
                s["end"].alias("end"),
                F.lit(name).alias("kind"),
            ),
        )

    fixed = F.concat(*(named(spans, name) for name, spans in base.items())).cast(kind)
    df = df.withColumn("_spans", fixed)
    if limits:
        limit = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
        free = lambda t: ~F.exists("_spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        random = F.filter(tokens(whole), lambda t: (t["step"] < F.element_at(limit, t["size"])) & free(t))
        inside = lambda t, s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]) & (s["end"] - s["start"] > t["end"] - t["start"])
        widest = _let(random, lambda found: F.filter(found, lambda t: ~F.exists(found, lambda s: inside(t, s))))
        df = df.withColumn("_spans", F.concat("_spans", named(widest, "random").cast(kind)))
    return df.withColumn("_spans", F.array_sort("_spans"))


def redacted(df: DataFrame, text: str = "text", mark: str = "<secret>", level: float = LEVEL) -> DataFrame:
    """`df` with every secret in its text replaced by `mark`, overlapping ones together."""
    found = scanned(df, text, level)

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], kept, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.char_length(text)))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", begin, step, rest)).otherwise(F.col(text))
    return found.withColumn(text, clean).drop("_spans")


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

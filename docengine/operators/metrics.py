"""Evaluation: confusion counts, text distances, intervals by bootstrap, areas."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.session import cut


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates from expected, predicted and abstained; a zero denominator gives null."""
    e, p = F.col("expected"), F.col("predicted") & ~F.col("abstained")
    n = df.groupBy(*keys).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"), F.count_if(F.col("abstained")).alias("abstained"), F.count("*").alias("n"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(F.col("n") - F.col("abstained"), F.col("n")).alias("coverage"))


def _distance(x: Sequence, y: Sequence) -> int:
    """Edit distance of two sequences, a column of the table at a time as the bits of integers (Myers, Hyyrö)."""
    if not x:
        return len(y)
    places: dict = {}
    for i, u in enumerate(x):
        places[u] = places.get(u, 0) | 1 << i
    full, top = (1 << len(x)) - 1, len(x) - 1
    up, down, n = full, 0, len(x)
    for v in y:
        same = places.get(v, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        n += (more >> top & 1) - (less >> top & 1)
        more, less = more << 1 | 1, less << 1
        up, down = full & (less | ~(level | more)), full & more & level
    return n


def _near_distance(x: str, y: str, most: int) -> int | None:
    """Edit distance of two texts if it is at most ``most``: how far each diagonal is reached with 0, 1, 2, ... edits (Ukkonen)."""
    n, m = len(x), len(y)

    def same(i: int, j: int) -> int:
        """x's place after the characters from i on that are those of y from j on, by pieces of growing and shrinking size."""
        left = min(n - i, m - j)
        if left <= 0 or x[i] != y[j]:
            return i
        size = 16
        while size <= left and x[i : i + size] == y[j : j + size]:
            i, j, left, size = i + size, j + size, left - size, size * 2
        while size > 1:
            size //= 2
            if size <= left and x[i : i + size] == y[j : j + size]:
                i, j, left = i + size, j + size, left - size
        return i

    low, reached = 0, [same(0, 0)]
    for edits in range(most + 1):
        if low <= m - n < low + len(reached) and reached[m - n - low] == n:
            return edits
        before, first = [-1, -1, *reached, -1, -1], max(low - 1, -n)
        last = min(low + len(reached), m)
        now = []
        for k in range(first, last + 1):
            at = k - low + 2
            i = min(max(before[at] + 1, before[at - 1], before[at + 1] + 1), n, m - k)
            now.append(same(i, i + k))
        low, reached = first, now
    return None


@F.pandas_udf(T.LongType())
def character_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts in characters (code points), null if one is null.

    Texts that are alike cost the square of their distance; others, after as many steps as characters, go by bits.
    """

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        near = _near_distance(x, y, math.isqrt(2 * max(len(x), len(y))) + 4)
        return _distance(x, y) if near is None else near

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_errors(df: DataFrame, expected: str, actual: str, *keys: str) -> DataFrame:
    """Micro-averaged word error rate."""
    words = F.size(F.filter(F.split(expected, r"\s+"), lambda w: w != ""))
    each = df.select(*keys, word_distance(expected, actual).alias("e"), words.alias("n"))
    return each.groupBy(*keys).agg(F.sum("e").alias("errors"), F.sum("n").cast("long").alias("words")).withColumn("wer", F.try_divide(F.col("errors").cast("double"), F.col("words")))


def character_errors(df: DataFrame, expected: str, actual: str, *keys: str) -> DataFrame:
    """Micro-averaged character error rate; equal pairs of texts are compared once."""
    each = df.groupBy(*keys, expected, actual).agg(F.count("*").alias("_n")).withColumn("_e", character_distance(expected, actual))
    total = each.groupBy(*keys).agg(F.sum(F.col("_e") * F.col("_n")).alias("errors"), F.sum(F.length(expected) * F.col("_n")).cast("long").alias("chars"))
    return total.withColumn("cer", F.try_divide(F.col("errors").cast("double"), F.col("chars")))


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts in words."""
    return pd.Series([_distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def iou_pairs(left: DataFrame, right: DataFrame, page: str, at_least: float = 0.5) -> DataFrame:
    """Each box of left (x0, y0, x1, y1) with the boxes of right (ox0, oy0, ox1, oy1) of its page whose IoU is at_least or more, as ``iou``.

    Such boxes' widths (and heights) differ by a factor of 1 / at_least at most, and their first corners by
    (1 - at_least) times the wider one. Boxes are keyed by page, binary classes of width and height, and the cell
    of their first corner in a grid of the class's size; left's boxes are listed under all keys that a
    partner can have. So candidates are alike in size and place, however many boxes a page has.
    Boxes without an area, and such with nulls, have no partners. Names other than the page must differ.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must lie between 0 and 1")
    slack = 1 + 1e-9  # of rounding in what follows
    size_class = lambda x: F.floor(F.log2(x)).cast("int")
    cell = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k + 1)).cast("long")

    def keyed(df: DataFrame, low: str, high: str, to: str) -> DataFrame:
        return df.withColumn(f"_c{to}", size_class(F.col(high) - F.col(low))).withColumn(f"_k{to}", cell(F.col(low), F.col(f"_c{to}")))

    def listed(df: DataFrame, low: str, high: str, to: str) -> DataFrame:
        extent, at = F.col(high) - F.col(low), F.col(low)
        present = [r[0] for r in other.select(f"_c{to}").distinct().collect()]  # as many as there are exponents of a double, 2098 at most
        alike = F.sequence(size_class(extent * at_least / slack), size_class(extent / at_least * slack))
        df = df.withColumn(f"_c{to}", F.explode(F.array_intersect(alike, F.array(*map(F.lit, present)).cast("array<int>"))))
        widest = F.least(F.pow(F.lit(2.0), F.col(f"_c{to}") + 1), extent / at_least)
        reach = (1 - at_least) * F.greatest(extent, widest) * slack + 1e-12
        return df.withColumn(f"_k{to}", F.explode(F.sequence(cell(at - reach, F.col(f"_c{to}")), cell(at + reach, F.col(f"_c{to}")))))

    own = left.filter("x1 > x0 and y1 > y0")
    other = keyed(keyed(right.filter("ox1 > ox0 and oy1 > oy0"), "ox0", "ox1", "x"), "oy0", "oy1", "y")
    both = listed(listed(own, "x0", "x1", "x"), "y0", "y1", "y").join(other, [page, "_cx", "_kx", "_cy", "_ky"]).drop("_cx", "_kx", "_cy", "_ky")
    corners = ("x0", "y0", "x1", "y1")
    return both.withColumn("iou", iou(tuple(F.col(c) for c in corners), tuple(F.col(f"o{c}") for c in corners))).filter(F.col("iou") >= at_least)


def first_fit(pairs: DataFrame, page: str) -> DataFrame:
    """One-to-one pairs (n, m) of each page: every n in order takes its first m that is still free."""

    def take(batch: pa.Table) -> pa.Table:
        n, m = (batch[c].to_numpy() for c in ("n", "m"))
        order = np.lexsort((m, n))
        used, last, keep = set(), None, []
        for k, i, o in zip(order.tolist(), n[order].tolist(), m[order].tolist(), strict=True):
            if i != last and o not in used:  # the n come in order
                last = i
                used.add(o)
                keep.append(k)
        return batch.take(pa.array(keep, pa.int64()))

    return pairs.groupBy(page).applyInArrow(take, pairs.schema)


#: The generator's factor, increment and modulus.
_FACTOR, _INCREMENT, _MODULUS = 1664525, 1013904223, 1 << 32
_CHUNK = 1024


def _steps(n: int) -> tuple[int, int]:
    """(a, c) so that n steps of the generator take a state s to (a s + c) modulo its modulus, by squaring."""
    a, c, fa, fc = 1, 0, _FACTOR, _INCREMENT
    while n:
        if n & 1:
            a, c = fa * a % _MODULUS, (fa * c + fc) % _MODULUS
        fa, fc = fa * fa % _MODULUS, (fa * fc + fc) % _MODULUS
        n >>= 1
    return a, c


def _stepped(a: Column, c: Column, s: Column) -> Column:
    """(a s + c) modulo 2^32 in whole numbers of 64 bits: the state goes by halves."""
    low, high = s.bitwiseAND(F.lit(0xFFFF)), F.shiftright(s, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16) + c).bitwiseAND(F.lit(_MODULUS - 1))


def draws(spark: SparkSession, objects: int, rounds: int, seed: int) -> DataFrame:
    """(round, place, k): how often each round draws each of ``objects`` places; places without draws are absent.

    The generator is read as if round after round took its draws one by one. A row begins with the state
    before a chunk of draws (a jump by the binary digits of its number), and each draw in it is one step from
    there by a table; so rounds and chunks are dealt over the tasks.
    """
    chunks = -(-objects // _CHUNK)
    jumps = "array(" + ", ".join("struct({}L as a, {}L as c)".format(*_steps(1 << k)) for k in range(62)) + ")"
    table = [_steps(j + 1) for j in range(min(_CHUNK, objects))]
    tables = [F.expr("array(" + ", ".join(f"{t[i]}L" for t in table) + ")") for i in (0, 1)]
    rows = spark.range(rounds * chunks, numPartitions=max(1, min(rounds * chunks, spark.sparkContext.defaultParallelism * 4)))
    rows = rows.select(F.expr(f"id div {chunks}").alias("round"), (F.expr(f"id % {chunks}") * _CHUNK).alias("at"))
    n = F.col("round") * objects + F.col("at")
    bits = F.filter(F.transform(F.expr(jumps), lambda x, k: F.struct(x["a"].alias("a"), x["c"].alias("c"), F.pmod(F.floor(n / F.pow(F.lit(2.0), k)), F.lit(2)).alias("on"))), lambda x: x["on"] == 1)
    state = F.aggregate(bits, F.lit(seed % _MODULUS).cast("long"), lambda s, x: _stepped(x["a"], x["c"], s))
    rows = rows.withColumn("state", state).withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(_CHUNK), objects - F.col("at")).cast("int") - 1)))
    drawn = _stepped(tables[0][F.col("j")], tables[1][F.col("j")], F.col("state"))
    return rows.groupBy("round", F.floor(drawn / float(_MODULUS) * objects).cast("long").alias("place")).agg(F.count("*").alias("k"))


def bootstrap(rows: DataFrame, object_id: str, measure: Callable[[Column], Column], rounds: int = 2000, seed: int = 20260927) -> DataFrame:
    """One row (objects, valid, low, high, reason): the 95 % percentile interval of a measure over resampled objects.

    Each round draws as many objects as there are, with repeats, by a seeded generator over the objects in
    the order of their ids; an object brings all its rows as often as it is drawn. ``measure`` makes an aggregate from the
    column of that number, such as ``lambda k: F.try_divide(F.sum(F.col("hits") * k), F.sum(F.col("n") * k))``. The interval
    is null for fewer than two objects, or if under 95 % of the rounds have a measure. Rows without an object don't count.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(object_id).isNotNull())
    names = cut(rows.select(F.col(object_id).alias("_object")).distinct().orderBy("_object").withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = names.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a task
    n = sum(r[1] for r in sizes)
    if n < 2:
        return spark.createDataFrame([(n, 0, None, None, "fewer than two independent objects")], "objects long, valid long, low double, high double, reason string")
    before, total = {}, 0
    for p, count in sizes:
        before[p] = total
        total += count
    offset = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])[part]
    placed = names.select("_object", (offset + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    sample = draws(spark, n, rounds, seed).join(placed, "place").join(rows.withColumnRenamed(object_id, "_object"), "_object")
    values = sample.groupBy("round").agg(measure(F.col("k")).cast("double").alias("x")).filter("x is not null and not isnan(x) and abs(x) < double('inf')")
    ranked = cut(values.withColumn("r", F.row_number().over(Window.orderBy("x")) - 1))  # one row a round
    valid = ranked.count()
    if valid / rounds < 0.95:
        return spark.createDataFrame([(n, valid, None, None, "too many undefined-denominator resamples")], "objects long, valid long, low double, high double, reason string")
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("x")))
    return ranked.agg(F.lit(n).cast("long").alias("objects"), F.lit(valid).cast("long").alias("valid"), at(math.floor(0.025 * (valid - 1))).alias("low"), at(math.ceil(0.975 * (valid - 1))).alias("high"), F.lit(None).cast("string").alias("reason"))


def _covered(boxes: list[tuple]) -> float:
    """The area that boxes (x0, y0, x1, y1) cover together: strips between neighbouring x, with the boxes over a strip kept in order of y."""
    boxes = [b for b in boxes if b[0] < b[2] and b[1] < b[3]]
    begins, ends = sorted(boxes), sorted((b[2], b[1], b[3]) for b in boxes)
    xs = sorted({x for b in boxes for x in (b[0], b[2])})
    area, held, i, j = 0.0, [], 0, 0
    for left, right in zip(xs, xs[1:], strict=False):
        while j < len(ends) and ends[j][0] <= left:
            del held[bisect_left(held, ends[j][1:])]
            j += 1
        while i < len(begins) and begins[i][0] <= left:
            insort(held, (begins[i][1], begins[i][3]))
            i += 1
        low = high = None
        for y0, y1 in held:
            if high is None or y0 > high:
                area += (high - low) * (right - left) if high is not None else 0.0
                low, high = y0, y1
            else:
                high = max(high, y1)
        area += (high - low) * (right - left) if high is not None else 0.0
    return area


def union_area(boxes: DataFrame, key: str) -> DataFrame:
    """(key, area): the area that each key's boxes cover together, swept key by key over sorted partitions.

    A task goes over all its keys in one pass and holds one key's boxes. Boxes with a missing coordinate cover nothing.
    """

    def swept(batches):
        now, held, seen = None, [], False
        for batch in batches:
            keys, areas = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or row[0] != now:
                    if seen:
                        keys.append(now)
                        areas.append(_covered(held))
                    now, held, seen = row[0], [], True
                if not any(v is None or v != v for v in row[1:]):
                    held.append(row[1:])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(areas, pa.float64())], [key, "area"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([_covered(held)], pa.float64())], [key, "area"])

    rows = boxes.select(key, *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(swept, f"{key} {dict(boxes.dtypes)[key]}, area double")


def _in_order(rows: DataFrame, key: str, order: str, size: str, begun: Callable) -> DataFrame:
    """rows with ``_made``: what the function that begun() gives for a key says to each of its sizes in order; null for a null size.

    A task goes over its sorted keys in one pass and holds one batch, whatever the keys' number or length.
    """

    def run(batches):
        now, step, seen = None, None, False
        for batch in batches:
            made = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if not seen or k != now:
                    now, step, seen = k, begun(), True
                made.append(None if n is None else step(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int32())], [*batch.schema.names, "_made"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(F.col(key), F.asc_nulls_last(order)).mapInArrow(run, f"{fields}, _made int")


def packed(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy chunks of each key's rows in order, at most ``budget`` bytes each; larger rows are dropped whole (chunk null)."""

    def begun():
        chunk, used = 0, 0

        def step(n):
            nonlocal chunk, used
            if n > budget:
                return None
            if used + n > budget:
                chunk, used = chunk + 1, 0
            used += n
            return chunk

        return step

    return _in_order(rows, key, order, size, begun).withColumnRenamed("_made", "chunk")


def admitted(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The rows of each key admitted in order while they fit; one that doesn't is skipped and later ones may still fit."""

    def begun():
        left = budget

        def step(n):
            nonlocal left
            fits = n <= left
            left -= n if fits else 0
            return int(fits)

        return step

    return _in_order(rows, key, order, size, begun).filter("_made = 1").drop("_made")

"""Benchmark decontamination by SimHash over item-sized windows.

A window's fingerprint is the 64-bit SimHash of its word shingles, repeats counting as often as
they occur. Items are put into size classes (by number of shingles, each class about 1.5 times
the one before); the windows of a class are a little shorter than its smallest item, so that a
passage always holds a whole window at any alignment of the stride, and every item is indexed by
all its windows of that length. A passage taken over as it is therefore meets one of its item's
fingerprints exactly.

Fingerprints are looked up by ``radius + 1`` blocks of bits: two that differ in at most
``radius`` bits agree in a block, so all pairs within the radius are found.

A changed word alters ``size`` shingles and so moves a window's fingerprint too far; passages
edited in every window are found by windows of a single shingle, whose fingerprint is the
shingle's hash. A piece that reaches the threshold lacks at most (1 - threshold) of the item's
shingles, so one more than that, those in the fewest items, are looked up for each item: at least
one of them is in the piece, wherever words were changed, inserted or deleted. For every candidate the
weighted Jaccard similarity (shingles weighted by their multiplicity) of the item and each
item-sized piece around the place is computed exactly; the best must reach the threshold.

Items are held by the tasks in passes of at most ``items_per_pass`` items and
``bytes_per_pass`` bytes; a longer benchmark takes more passes, one after the other, each of which
reads the texts, so that what is broadcast at a time has a bound. Null or empty texts and items
match nothing. An item or document of fewer than ``size`` words has its whole sequence as the one
shingle, so an item that short is found only as a whole text. Every window starts at a multiple of
the stride from its row's first shingle: repeated rows are judged alike, wherever they stand. Whole
texts are scanned. Of equally similar pieces the first counts. Other columns are ignored, whatever
their names; an empty table or benchmark gives no hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import chunks, lean, shingle_hashes, word_hashes
from docengine.session import cut

CHUNK = 1 << 19
HITS = "item_id long, similarity double, first_shingle int, n_shingles int"


def size_class(n: int) -> tuple[int, int, int]:
    """(smallest size, stride, window) in shingles of the class of items with n shingles."""
    low = 1
    while (nxt := max(low + 1, low * 3 // 2)) <= n:
        low = nxt
    stride = max(1, low // 4)
    return low, stride, low - stride + 1


class Fingerprints:
    """SimHash of windows over one sequence of shingles.

    A shingle's 64 bits are 64 bytes, eight to a word, so that sums of up to 255 shingles are
    plain additions of words. Sums over powers of two are shared by all window lengths.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)
        self.levels = [self.bits.view(np.uint64)]

    def _level(self, p: int) -> np.ndarray:
        while len(self.levels) <= p:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(last[:-step] + last[step:])
        return self.levels[p]

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        """The fingerprints of the windows of ``width`` shingles that begin at ``starts``."""
        if width > 255:
            sums = np.concatenate([np.zeros((1, 64), np.uint32), np.cumsum(self.bits, axis=0, dtype=np.uint32)])
            return np.packbits((sums[starts + width] - sums[starts]) > width // 2, axis=1).view(np.uint64).ravel()
        total = np.zeros((len(starts), 8), np.uint64)
        place = starts
        for p in range(width.bit_length() - 1, -1, -1):
            if width >> p & 1:
                total += self._level(p)[place]
                place = place + (1 << p)
        return np.packbits(total.view(np.uint8) > width // 2, axis=1).view(np.uint64).ravel()


def fingerprints(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of values[s : s + width] for each s in starts."""
    return Fingerprints(values).at(starts, width)


def best_piece(own: tuple[np.ndarray, np.ndarray], n: int, values: np.ndarray, first: int, last: int) -> tuple[float, int, int]:
    """The most similar piece of a row: (similarity, begin, end), the first of equals.

    ``own`` are the item's distinct shingles, ascending, and how often each occurs; ``values`` are
    the row's shingles. Pieces of ``n`` shingles begin at ``first`` to ``last``, cut off at the
    row's ends. A shingle that occurs c times in the item counts for the pieces in which it is one
    of the first c of its value, which are those that begin behind the c-th before it.
    """
    low, high = max(first, 0), min(last + n, len(values))
    at = np.minimum(np.searchsorted(own[0], values[low:high]), len(own[0]) - 1)
    place = np.flatnonzero(own[0][at] == values[low:high])
    kind = at[place]
    order = np.argsort(kind, kind="stable")
    kind, place = kind[order], place[order] + low
    back = np.arange(len(kind)) - own[1][kind]
    behind = np.maximum(back, 0)
    known = (back >= 0) & (kind[behind] == kind)
    begin = np.maximum(np.where(known, place[behind] + 1, first), np.maximum(place - n + 1, first))
    end = np.minimum(place, last) + 1
    counts = begin < end
    steps = np.bincount(begin[counts] - first, minlength=last - first + 2) - np.bincount(end[counts] - first, minlength=last - first + 2)
    shared = np.cumsum(steps)[:-1]
    starts = np.arange(first, last + 1)
    total = n + np.minimum(starts + n, len(values)) - np.maximum(starts, 0) - shared
    found = shared / total
    k = int(np.argmax(found))
    return float(found[k]), max(first + k, 0), min(first + k + n, len(values))


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    shared = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - shared
    return shared / total if total else 0.0


class ItemIndex:
    """Fingerprints of some items by class and block, and the items' shingles."""

    def __init__(self, ids: list[int], texts: list[str], size: int, radius: int, threshold: float = 0.8) -> None:
        self.size, self.radius, self.threshold = size, radius, threshold
        values, bounds = shingle_hashes(*word_hashes(pa.array(texts, pa.string())), size)
        self.items = {}
        found: dict[tuple[int, int, int], list] = {}
        for i, item in enumerate(ids):
            own = values[bounds[i] : bounds[i + 1]]
            if len(own):
                self.items[i] = (item, len(own), np.unique(own, return_counts=True))
                cls = size_class(len(own))
                offsets = np.arange(len(own) - cls[2] + 1)
                prints = fingerprints(own, offsets, cls[2])
                found.setdefault(cls, []).append((prints, np.full(len(offsets), i), offsets))
        self.classes = {}
        for cls, parts in found.items():
            prints, owners, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
            blocks = []
            for shift, width in self.blocks():
                keys = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                order = np.argsort(keys, kind="stable")
                blocks.append((order, np.searchsorted(keys[order], np.arange((1 << width) + 1))))
            self.classes[cls] = (prints, owners, offsets, blocks)
        self._index_singles()

    def _index_singles(self) -> None:
        """The single shingles of which every piece that reaches the threshold holds one."""
        kinds = [own[0] for _, _, own in self.items.values()]
        every, n_items = np.unique(np.concatenate(kinds or [np.zeros(0, np.uint64)]), return_counts=True)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (_, n, (kind, times)) in self.items.items():
            order = np.argsort(n_items[np.searchsorted(every, kind)], kind="stable")
            lacking = int((1 - self.threshold) * n + 1e-9)
            some = order[: np.searchsorted(np.cumsum(times[order]), lacking + 1) + 1]
            keys.append(kind[some])
            owners.append(np.full(len(some), i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.singles = keys[order], owners[order]
        self.mask = np.uint64((1 << max(16, (16 * len(keys)).bit_length())) - 1)
        self.listed = np.zeros(int(self.mask) + 1, bool)
        self.listed[keys & self.mask] = True

    def blocks(self) -> list[tuple[int, int]]:
        """(shift, width) of each block of bits."""
        edges = [64 * i // (self.radius + 1) for i in range(self.radius + 2)]
        return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]

    def candidates(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (row, item, first shingle) with fingerprints within the radius."""
        out = []
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        sums = Fingerprints(values)
        for (_, stride, width), (prints, owners, offsets, blocks) in self.classes.items():
            if len(values) < width:
                continue
            n = np.maximum((np.diff(bounds) - width) // stride + 1, 0)  # each row's windows, from its first shingle on
            starts = np.repeat(bounds[:-1], n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            own = sums.at(starts, width)
            for (shift, bits), (order, edge) in zip(self.blocks(), blocks, strict=True):
                key = ((own >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                n = edge[key + 1] - edge[key]
                which = np.repeat(np.arange(len(starts)), n)
                entry = order[np.repeat(edge[key] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = np.bitwise_count(own[which] ^ prints[entry]) <= self.radius
                which, entry = which[near], entry[near]
                out.append(np.stack([row_of[starts[which]], owners[entry], starts[which] - offsets[entry]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def touched(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(row, item, shingle) for every listed single shingle of the rows."""
        keys, owners = self.singles
        place = np.flatnonzero(self.listed[values & self.mask])
        low = np.searchsorted(keys, values[place])
        n = np.searchsorted(keys, values[place], "right") - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(place, n)
        return np.stack([np.searchsorted(bounds, place, "right") - 1, owners[entry], place], axis=1)

    def hits(self, column: pa.Array, threshold: float) -> list[dict[int, tuple[float, int, int]]]:
        """For each row, the best (similarity, first shingle, shingles) of each item that it holds."""
        if threshold < self.threshold:
            raise ValueError("the index was made for a higher threshold")
        values, bounds = shingle_hashes(*word_hashes(column), self.size)
        out: list[dict] = [{} for _ in range(len(column))]
        places = np.concatenate([self.candidates(values, bounds), self.touched(values, bounds)])
        places = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
        if not len(places):
            return out
        sizes = np.array([self.items[i][1] if i in self.items else 0 for i in range(max(self.items) + 1)])
        far = np.diff(places[:, 2]) > 2 * sizes[places[1:, 1]]
        edges = np.flatnonzero((np.diff(places[:, :2], axis=0) != 0).any(axis=1) | far) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
            row, i = places[start, :2].tolist()
            item, n, own = self.items[i]
            length = int(bounds[row + 1] - bounds[row])
            first, last = (int(places[k, 2] - bounds[row]) for k in (start, end - 1))
            s, low, high = best_piece(own, n, values[bounds[row] : bounds[row + 1]], first - n + 1, min(last, length - 1))
            if s >= threshold and (item not in out[row] or s > out[row][item][0]):
                out[row][item] = (s, low, high - low)
        return out


def _passes(items: DataFrame, id_col: str, text_col: str, items_per_pass: int, bytes_per_pass: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in parts of bounded size; an item longer than bytes_per_pass is a part of its own."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if ids and (len(ids) >= items_per_pass or held + len(row[1]) > bytes_per_pass):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    yield ids, texts


def _each(spark, passes: Iterator[tuple[list[int], list[str]]], size: int, radius: int, threshold: float, apply: Callable) -> None:
    """Calls apply(index, whether it is the only or last pass); an earlier pass has its broadcast freed behind it."""
    ahead = next(passes, None)
    while ahead is not None:
        held = spark.sparkContext.broadcast(ItemIndex(*ahead, size, radius, threshold))
        ahead = next(passes, None)
        apply(held, ahead is None)
        if ahead is not None:
            held.destroy()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, radius: int = 3, items_per_pass: int = 5000, bytes_per_pass: int = 16 << 20) -> DataFrame:
    """(id, item_id, similarity, first_shingle, n_shingles): one row per document and item it holds."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    rows = [(k, item, *hit) for k, found in enumerate(index.hits(part.column("text"), threshold)) for item, hit in found.items()]
                    ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int32()))
                    kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds))], ["id", "item_id", "similarity", "first_shingle", "n_shingles"])

        return source.mapInArrow(lean(run), f"id {kind}, {HITS}")

    found: list[DataFrame] = []

    def apply(held, last: bool) -> None:
        found.append(search(held) if last else cut(search(held)))

    _each(docs.sparkSession, _passes(items, item_id, item_text, items_per_pass, bytes_per_pass), size, radius, threshold, apply)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, radius: int = 3, items_per_pass: int = 5000, bytes_per_pass: int = 16 << 20) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""

    def keep(held, name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for part in chunks(batch, name, CHUNK):
                    column = part.column(part.schema.get_field_index(name))
                    yield part.filter(pa.array([not x for x in index.hits(column, threshold)], pa.bool_()))

        return run

    left = docs

    def apply(held, last: bool) -> None:
        nonlocal left
        left = left.mapInArrow(lean(keep(held, text_col)), docs.schema)
        left = left if last else cut(left)

    _each(docs.sparkSession, _passes(items, item_id, item_text, items_per_pass, bytes_per_pass), size, radius, threshold, apply)
    return left


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and where it lies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Removal of repeated byte strings: every byte covered by a ``length``-byte string that also
starts anywhere else, in the same text or in another.

Sorting all suffixes of the corpus takes more than ten bytes a suffix in every exchange, so the
suffixes are first narrowed down without loss. Of every ``length`` bytes, the block of ``block``
bytes with the smallest hash is an anchor (all of equal hashes are); two equal strings have
equal anchors at equal places. Anchors that occur once are done with. The others' contexts (all
strings that hold the anchor) are dealt into suffix buckets by anchor. A bucket has a fixed size,
and their number follows from the counted contexts; a task holds one bucket at a time.

Within a bucket, suffixes are grouped blockwise with a difference cover. The cover sample (every
position whose place modulo 13, counted from the anchor, is in the cover) gets ranks by doubling
of what follows it, 13 to 104 bytes; ranks are equal for equal bytes at one place, in no order.
Then one block of suffixes is grouped at a time, those that begin at one distance before their
anchors: by their first bytes up to the next sample position, the ranks there and at the last
sample position from which 104 bytes fit, and the bytes that remain. So ties of any length are
settled by ranks, bytes are compared exactly, and no array is longer than the sample.

Contexts that repeat within a chunk of rows are settled there and passed on once, so a passage
that occurs in any share of the rows reaches a bucket once a chunk. Where all contexts of an
anchor are equal, 128-bit digests are passed on and not their bytes. Anchors in more than ``hot``
different contexts would make a bucket outgrow the others; their strings are dealt one by one,
under two names of 64 and 62 bits, so that equal strings in any number meet once a chunk.

The tables of anchors that tasks hold (repeated, with different contexts, hot) have fixed sizes;
with too many anchors for them they only sieve less. Null texts count as empty. Repeated rows are
texts of their own, so two equal rows of ``length`` bytes or more are removed whole. Texts are read
whole, long ones in overlapping pieces, and matches never cross them. Other columns are ignored,
whatever their names. An empty table gives an empty result. There are no ties: all equal strings
count alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.sieve import parted
from docengine.llm.words import chunks, lean, mixed, prefix_hash, prime_sums, prime_spans, raw_bytes, span_hash
from docengine.session import cut

BITMAP_BITS = 26
CHUNK = 3 << 19
BUCKET = 1 << 14  # contexts
HELD = 24 << 20  # bytes of contexts that a task gathers before it passes them on
_SPANS = "id long, th long, start int, stop int"

# A difference cover modulo 13 (all differences occur).
PERIOD, COVER = 13, (0, 1, 3, 9)


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick.reduce of each run of ``width`` neighbours, by prefix and suffix runs within blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    fill = x[-1]
    padded = np.concatenate([x, np.full(-len(x) % width, fill, x.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    behind = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


class Piece(NamedTuple):
    """Texts side by side; each row's place in its text, and which of its positions are its own."""

    data: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray
    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray


def pieces(column: pa.Array, length: int, size: int) -> Iterator[Piece]:
    """The rows at once, or a row longer than twice ``size`` in pieces.

    Pieces overlap by ``length`` bytes on both sides, which is all that the anchors of a piece's
    own positions depend on.
    """
    data, offsets = raw_bytes(column)
    n = len(offsets) - 1
    if n != 1 or len(data) <= 2 * size:
        zero = np.zeros(n, np.int64)
        yield Piece(data, offsets, np.arange(n), zero, zero, np.diff(offsets))
        return
    for at in range(0, len(data), size):
        low, high = max(0, at - length), min(len(data), at + size + length)
        yield Piece(data[low:high], np.array([0, high - low]), np.zeros(1, np.int64), np.array([low]), np.array([at - low]), np.array([min(at + size, len(data)) - low]))


class Anchored:
    """The anchors of one piece."""

    def __init__(self, piece: Piece, length: int, block: int) -> None:
        self.data, self.offsets = piece.data, piece.offsets
        self.h = prefix_hash(self.data)
        n, reach = len(self.data), length - block + 1
        row_end = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.positions = np.zeros(0, np.int64)
        if n >= length:
            at = np.arange(n - block + 1)
            names = span_hash(self.h, at, at + block)
            low = sliding(names, reach, np.minimum)  # one for each string
            inside = np.arange(len(low)) + length <= row_end[: len(low)]
            low[~inside] = 0
            edge = np.zeros(reach - 1, low.dtype)
            best = sliding(np.concatenate([edge, low, edge]), reach, np.maximum)
            inside = np.concatenate([edge.astype(bool), inside, edge.astype(bool)])
            count = np.concatenate([[0], np.cumsum(inside)])
            some = count[reach:] - count[:-reach] > 0
            self.positions = np.flatnonzero((names == best) & some)
        self.row = np.searchsorted(self.offsets, self.positions, side="right") - 1
        place = self.positions - self.offsets[self.row]
        own = (place >= piece.low[self.row]) & (place < piece.high[self.row])
        self.positions, self.row = self.positions[own], self.row[own]
        self.names = span_hash(self.h, self.positions, self.positions + block)

    def content(self, which: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the strings that hold the anchors begin and end, and a name of what lies between."""
        p, row = self.positions[which], self.row[which]
        low, high = np.maximum(p - (length - block), self.offsets[row]), np.minimum(p + length, self.offsets[row + 1])
        return low, high, span_hash(self.h, low, high) ^ mixed((p - low).astype(np.uint64) + self.names[which])


def _bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**bits hashed names; at most 2**(bits - 6) rows reach the driver."""
    slot = f"shiftrightunsigned(name, {64 - bits})"
    words = keys.groupBy(F.expr(f"{slot} div 64").cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table


def _marked(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    bits = 6 + (len(table) - 1).bit_length()
    slot = names >> np.uint64(64 - bits)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _repeats(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether each key occurs again or on a flagged row."""
    codes, different = pd.factorize(keys)
    known = np.bincount(codes, minlength=len(different)) > 1
    known[codes[flags]] = True
    return known[codes]


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first row of each different key, and for each row whether its key repeats."""
    _, first, slot, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, size[slot] > 1, size > 1


def repeated_spans(docs: DataFrame, length: int = 200, block: int = 68, hot: int = BUCKET, chunk: int = CHUNK, bucket_rows: int = BUCKET) -> DataFrame:
    """(id, th, start, stop): byte spans of docs' (id, th, text) that repeat; they may overlap.

    hot: different contexts (counted once a chunk) from which an anchor is dealt by string.
    """
    spark = docs.sparkSession

    def name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", chunk):
                for piece in pieces(part.column("text"), length, chunk):
                    a = Anchored(piece, length, block)
                    content = a.content(np.arange(len(a.positions)), length, block)[2]
                    order = np.lexsort((content, a.names))
                    names, content = a.names[order], content[order].view(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
                    new = np.concatenate([[True], (names[1:] != names[:-1]) | (content[1:] != content[:-1])]) if len(names) else np.zeros(0, bool)
                    counts = np.diff(np.concatenate([first, [len(names)]])).astype(np.int32)
                    kinds = np.add.reduceat(new.astype(np.int32), first) if len(names) else counts
                    yield pa.RecordBatch.from_arrays([pa.array(names[first].view(np.int64)), pa.array(counts), pa.array(kinds.astype(np.int32)), pa.array(content[first])], ["name", "n", "k", "content"])

    counted = docs.select("text").mapInArrow(lean(name_anchors), "name long, n int, k int, content long").groupBy("name")
    counted = counted.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("k").alias("most"), F.min("content").alias("low"), F.max("content").alias("high")).filter("n > 1")
    counted = cut(counted.select("name", "k", F.expr("most > 1 or low < high").alias("differ")))
    held = counted.filter("differ").agg(F.sum("k")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // bucket_rows))
    tables = spark.sparkContext.broadcast((_bitmap(counted), _bitmap(counted.filter("differ")), _bitmap(counted.filter(F.col("k") > hot))))

    def dealt(piece: Piece, ids: np.ndarray, th: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
        """Rows for the buckets: 0: a span that is settled; 1: a context; 2: packed strings; 3: a context's digest."""
        repeated, different, frequent = tables.value
        a = Anchored(piece, length, block)
        keep = np.flatnonzero(_marked(repeated, a.names))
        low, high, content = a.content(keep, length, block)
        names, row = a.names[keep], a.row[keep]
        first, again, first_again = _firsts(content)
        out: list[list] = [[] for _ in _FIELDS]
        bodies: list[bytes] = []

        def add(kind: int, rows: np.ndarray, start: np.ndarray, stop: np.ndarray, body: list[bytes], bucket=None, name=None, name2=None, flag=None) -> None:
            n, none = len(rows), np.zeros(len(rows), np.uint64)
            begin, real = a.offsets[rows] - piece.shift[rows], piece.rows[rows]
            if bucket is None:  # settled spans go to any bucket
                bucket = mixed(start.astype(np.uint64) + mixed(ids[real].astype(np.uint64)))
            fields = (np.full(n, kind), bucket % np.uint64(n_buckets), ids[real], th[real], start - begin, stop - begin, none if name is None else name, none if name2 is None else name2, none if flag is None else flag)
            for to, x, (_, dtype) in zip(out, fields, _FIELDS, strict=False):
                to.append(x.astype(dtype))
            bodies.extend(body)

        empty = lambda n: [b""] * n
        if again.any():
            x, y, of = low[again], high[again], row[again]
            new = np.concatenate([[True], (x[1:] > y[:-1]) | (of[1:] != of[:-1])])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(x) - 1]])
            add(0, of[new], x[new], y[last], empty(int(new.sum())))
        buffer = a.data.tobytes()
        bytes_of = lambda which: [buffer[x:y] for x, y in zip(low[which].tolist(), high[which].tolist(), strict=True)]
        plain = ~_marked(different, names)
        alike = first[plain[first]]
        places = (a.positions[keep] - low).astype(np.uint64)
        digests = np.array([np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.uint64) for x in bytes_of(alike)], np.uint64).reshape(-1, 2)
        add(3, row[alike], low[alike], high[alike], empty(len(alike)), names[alike], digests[:, 0] ^ mixed(places[alike]), digests[:, 1], first_again[plain[first]])
        is_hot = _marked(frequent, names) & ~plain
        cold = first[~is_hot[first] & ~plain[first]]
        # start holds the anchor's place, stop the context's end
        add(1, row[cold], a.positions[keep][cold], high[cold], bytes_of(cold), names[cold], names[cold], None, first_again[~is_hot[first] & ~plain[first]])
        warm = first[is_hot[first]]
        if len(warm):
            n = high[warm] - low[warm] - length + 1
            start = np.unique(np.repeat(low[warm] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            own = span_hash(a.h, start, start + length)
            one, more, one_more = _firsts(own)
            rows = np.searchsorted(a.offsets, start, side="right") - 1
            for k in _runs(start[more], rows[more]):
                add(0, k[0], k[1], k[2] + length, empty(len(k[0])))
            second = prime_spans(prime_sums(a.data), start[one], start[one] + length)
            bucket = own[one] % np.uint64(n_buckets)
            packed = np.rec.fromarrays([own[one], second, (start - a.offsets[rows] + piece.shift[rows])[one].astype(np.int32), one_more], dtype=_STRING)
            order = np.lexsort((rows[one], bucket))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(rows[one][order]) != 0)]))
            owner = rows[one][order][edges]
            add(2, owner, a.offsets[owner], a.offsets[owner], [x.tobytes() for x in np.split(packed[order], edges[1:])], bucket[order][edges])
        return [np.concatenate(x) for x in out[:-1]], bodies

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[list[np.ndarray], list[bytes]]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([g[0][j] for g in gathered]) for j in range(len(_FIELDS) - 1)]
            bodies = [x for g in gathered for x in g[1]]
            order = np.argsort(columns[1], kind="stable")
            buckets, edges = np.unique(columns[1][order], return_index=True)
            blobs = [_packed([c[k] for c in columns], [bodies[j] for j in k]) for k in np.split(order, edges[1:])] if len(order) else []
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for part in chunks(batch, "text", chunk):
                ids, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
                for piece in pieces(part.column("text"), length, chunk):
                    gathered.append(dealt(piece, ids, th))
                    n += sum(map(len, gathered[-1][1])) + 64 * len(gathered[-1][1])
                    if n >= HELD:
                        yield flush()
                        gathered, n = [], 0
        if gathered:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        """The repeated strings of one suffix bucket."""
        table = _unpacked(table.column("blob").to_pylist())
        kind = table.column("kind").to_numpy()
        of = lambda k: table.filter(pa.array(kind == k))
        found = [of(0).select(["id", "th", "start", "stop"]), *_settle_contexts(of(1), length, block, bucket_rows), _settle_packed(of(2), length), _settle_names(of(3))]
        return pa.concat_tables(found)

    return docs.select("id", "th", "text").mapInArrow(lean(deal), "bucket int, blob binary").groupBy("bucket").applyInArrow(settle, _SPANS)


_FIELDS = (("kind", np.uint8), ("bucket", np.int32), ("id", np.int64), ("th", np.int64), ("start", np.int32), ("stop", np.int32), ("name", np.uint64), ("name2", np.uint64), ("flag", np.uint8), ("size", np.int32))
_STRING = np.dtype([("name", np.uint64), ("name2", np.uint64), ("start", np.int32), ("flag", bool)])


def _packed(columns: list[np.ndarray], bodies: list[bytes]) -> bytes:
    """Rows of one bucket, column by column, compressed."""
    columns = [*columns, np.array([len(x) for x in bodies])]
    parts = [x.astype(kind).tobytes() for x, (_, kind) in zip(columns, _FIELDS, strict=True)]
    return len(bodies).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, *bodies]))


def _unpacked(blobs: list[bytes]) -> pa.Table:
    fields: dict[str, list] = {name: [] for name, _ in _FIELDS}
    bodies = []
    for blob in blobs:
        n, data, at = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:]), 0
        for name, kind in _FIELDS:
            x = np.frombuffer(data, kind, n, at)
            fields[name].append(x)
            at += x.nbytes
        bodies.append(data[at:])
    columns = {name: np.concatenate(x) for name, x in fields.items()}
    ends = np.concatenate([[0], np.cumsum(columns.pop("size"), dtype=np.int64)])
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(bodies))])
    columns["name"], columns["name2"] = columns["name"].view(np.int64), columns["name2"].view(np.int64)
    columns["flag"] = columns["flag"].astype(bool)
    return pa.table({name: pa.array(x) for name, x in columns.items()} | {"body": body})


def _runs(start: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, last) of the runs of neighbouring starts (ascending)."""
    if not len(start):
        return []
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(rows) != 0)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return [(rows[new], start[new], start[last])]


def _spans(ids, th, start, stop) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "th": pa.array(th, pa.int64()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Equal ranks for equal keys of a column, from 0 on as they first occur.

    Strings are only asked for equality, and only against others of the same column: no order is needed, and a column's table stays small.
    """
    if keys.ndim == 1:
        return pd.factorize(keys)[0].astype(np.uint64)
    out = np.empty(keys.shape, np.uint64, order="F")
    for k in range(keys.shape[1]):
        out[:, k] = _ranks(np.ascontiguousarray(keys[:, k]))
    return out


def _text_at(slots: np.ndarray, column: int, n: int) -> np.ndarray:
    """The n <= 8 bytes from one column on of every slot, as one number."""
    x = np.zeros((len(slots), 8), np.uint8)
    x[:, 8 - n :] = slots[:, column : column + n]
    return x.view(">u8").ravel().astype(np.uint64)


class CoverRanks:
    """Ranks of the cover sample of slots that hold one context each, anchors at equal places.

    A rank of depth d tells whether the d bytes behind two sample positions are equal; depths
    double from 13 until two of them reach over a string.
    """

    def __init__(self, slots: np.ndarray, length: int) -> None:
        width = slots.shape[1]
        self.columns = np.array([c for c in range(width - PERIOD + 1) if c % PERIOD in COVER])
        self.at = np.full(width + 1, -1)
        self.at[self.columns] = np.arange(len(self.columns))
        self.next = np.array([min(c + k for k in range(PERIOD) if (c + k) % PERIOD in COVER) for c in range(width)])
        self.last = np.array([max((c - k for k in range(PERIOD) if (c - k) % PERIOD in COVER), default=-1) for c in range(width)])
        self.slots, self.depth = slots, PERIOD
        if len(slots) >= 1 << 24:
            raise ValueError("too many contexts for ranks of 24 bits")
        head = np.stack([_text_at(slots, c, 8) for c in self.columns], axis=1)
        rest = np.stack([_text_at(slots, c + 8, PERIOD - 8) for c in self.columns], axis=1)
        self.rank = _ranks((_ranks(head) << np.uint64(40)) | rest)
        while 2 * self.depth <= length - 2 * PERIOD:
            further = self.at[np.minimum(self.columns + self.depth, width)]
            know = further >= 0  # the others stand too near the end to be asked for
            both = self.rank.copy()
            both[:, know] = (self.rank[:, know] << np.uint64(32)) | self.rank[:, further[know]]
            self.rank = _ranks(both)
            self.depth *= 2

    def block(self, column: int, length: int, which: np.ndarray) -> np.ndarray:
        """Equal ranks for equal strings of ``length`` bytes that begin in one column of the slots ``which``."""
        head = self.next[column] - column  # bytes up to the next sample position
        key = (_text_at(self.slots, column, head) << np.uint64(24)) | self.rank[:, self.at[column + head]]
        at = column + head + self.depth
        while at + self.depth < column + length:
            key = (_ranks(key) << np.uint64(24)) | self.rank[:, self.at[at]]
            at += self.depth
        back = self.last[column + length - self.depth]  # the last sample position from which a rank's bytes fit
        rest = column + length - back - self.depth
        tail = (self.rank[:, self.at[back]] << np.uint64(40)) | _text_at(self.slots, back + self.depth, rest)
        return _ranks((_ranks(key[which]) << np.uint64(32)) | _ranks(tail[which]))


def _settle_contexts(table: pa.Table, length: int, block: int, most: int) -> Iterator[pa.Table]:
    """The repeated strings of a bucket's contexts; anchors are taken together in blocks of about ``most`` contexts."""
    if not table.num_rows:
        return
    table = table.sort_by("name")
    names = table.column("name").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield _sorted_block(table.slice(edges[at], edges[end] - edges[at]), length, block)
        at = end


def _sorted_block(table: pa.Table, length: int, block: int) -> pa.Table:
    body = table.column("body").combine_chunks()
    body = pa.concat_arrays(body.chunks) if isinstance(body, pa.ChunkedArray) else body
    data, offsets = raw_bytes(body)
    anchor, stop = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
    flags = table.column("flag").to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    left = size - (stop - anchor)  # bytes before the anchor
    reach = length - block + 1
    place = -(-reach // PERIOD) * PERIOD  # every slot's anchor begins here, so equal distances are equal columns
    slots = np.zeros((len(size), -(-(place + length) // PERIOD) * PERIOD), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    slots[row, np.arange(len(data)) - np.repeat(offsets[:-1], size) + np.repeat(place - left, size)] = data
    cover = CoverRanks(slots, length)
    again = np.zeros((len(size), reach), bool)
    for before in range(reach):  # strings that begin so many bytes before their anchor
        have = np.flatnonzero((left >= before) & (left - before + length <= size))
        again[have, before] = _repeats(cover.block(place - before, length, have), flags[have])
    edge = np.zeros((len(size), 1), np.int8)
    change = np.diff(np.concatenate([edge, again.astype(np.int8), edge], axis=1), axis=1)
    row, near = np.nonzero(change == 1)
    _, far = np.nonzero(change == -1)
    ids, th = (table.column(c).to_numpy()[row] for c in ("id", "th"))
    return _spans(ids, th, anchor[row] - (far - 1), anchor[row] - near + length)


def _settle_packed(table: pa.Table, length: int) -> pa.Table:
    if not table.num_rows:
        return _spans([], [], [], [])
    pieces = [np.frombuffer(x, _STRING) for x in table.column("body").to_pylist()]
    every = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    again = _repeats((_ranks(every["name"]) << np.uint64(32)) | _ranks(every["name2"]), every["flag"])
    every, owner = every[again], owner[again]
    order = np.lexsort((every["start"], owner))
    every, owner = every[order], owner[order]
    ids, th = (table.column(c).to_numpy() for c in ("id", "th"))
    out = [_spans(ids[r], th[r], s, e + length) for r, s, e in _runs(every["start"].astype(np.int64), owner)]
    return pa.concat_tables(out) if out else _spans([], [], [], [])


def _settle_names(table: pa.Table) -> pa.Table:
    keys = [_ranks(table.column(c).to_numpy().view(np.uint64)) for c in ("name", "name2")]
    again = _repeats((keys[0] << np.uint64(32)) | keys[1], table.column("flag").to_numpy(zero_copy_only=False))
    return table.filter(pa.array(again)).select(["id", "th", "start", "stop"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, block: int = 68, hot: int = BUCKET, chunk: int = CHUNK, bucket_rows: int = BUCKET) -> DataFrame:
    """(id, n_bytes, removed, kept) for each row: removed is the list of maximal [start, stop) byte
    spans, kept the remaining bytes. Only texts with spans are shuffled."""
    if not 0 < block < length or length < 2 * PERIOD:
        raise ValueError(f"the block must be shorter than the string, and the string have {2 * PERIOD} bytes at least")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keyed = source.withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))
    # a join by sorting at every size, so that small runs show what large ones cost
    found = cut(repeated_spans(keyed, length, block, hot, chunk, bucket_rows).groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))  # bounded by one text
    clear, maybe = parted(source, found.select("th"), "th", 24)
    rest = maybe.alias("d").join(found.hint("merge").alias("f"), F.expr(f"coalesce(d.id, {-(1 << 63) + 1}L - 1L) = f.id and d.th = f.th"), "left").select("d.id", "text", F.expr("transform(spans, s -> s.start)").alias("starts"), F.expr("transform(spans, s -> s.stop)").alias("stops"))
    none = F.lit(None).cast("array<int>")
    both = rest.unionByName(clear.select("id", "text", none.alias("starts"), none.alias("stops")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = raw_bytes(part.column("text"))
                sizes, removed, kept = [], [], []
                for i, (s, e) in enumerate(zip(part.column("starts").to_pylist(), part.column("stops").to_pylist(), strict=True)):
                    own = data[offsets[i] : offsets[i + 1]]
                    start, stop = np.array(s or [], np.int64), np.array(e or [], np.int64)
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(start) else stop
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(start) else start
                    runs = list(zip(start[new].tolist(), stop[np.concatenate([new[1:] - 1, [len(stop) - 1]])].tolist() if len(new) else [], strict=True))
                    sizes.append(len(own))
                    removed.append([{"start": x, "stop": y} for x, y in runs])
                    kept.append(b"".join(own[x:y].tobytes() for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(own)], strict=True)))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(lean(remove), "id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary").withColumnRenamed("id", id_col)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the rest."""
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The maximal removed spans of each text, by counting all strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            digest = hashlib.md5(t[i : i + length]).digest()
            seen[digest] = seen.get(digest, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[hashlib.md5(t[i : i + length]).digest()] > 1:
                gone[i + 1 : i + 1 + length] = 1
        step = np.diff(gone)
        out.append(list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)))
    return out

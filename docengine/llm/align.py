"""Alignment of two tokenizers' tokens by the byte offsets at which tokens of both end.

A is a byte-level BPE (a tokenizers JSON file), B a SentencePiece model. Both encode space + text, so
that their tokens cover the same bytes. Offsets where a token of A and one of B both end cut the tokens
into groups; tokens of one group are linked.

Both tokenizers treat a text piece by piece: no token crosses a space between two
characters that aren't white space (the vocabulary of B is checked for that; else texts are whole
pieces). So the texts of a block of documents become a dictionary of distinct pieces, whose tokens are
listed end to end, and for each document the numbers of its pieces. Higher-order functions align the
dictionary: array_intersect of the two arrays of ends gives the cuts, a merge of cuts and ends by
sort_array their places among the tokens. A document's groups and links are those of its pieces; they
are put together and summed a block at a time over Arrow arrays.

Texts that are null or empty, or whose tokens of A or B don't join to space + text (such as texts with
U+2581, which B reads as a space) have no tokens. Special tokens' strings are plain text. Texts are
encoded whole; a block is ``block_bytes`` of texts, or one longer text. Repeated rows give repeated
results, and count as documents each for itself; columns that aren't named are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.bpe import PATTERN, Vocabulary
from docengine.llm.stored import stored
from docengine.llm.words import lean

SPACE = "▁"  # fixed value: what stands for a space in a piece of B
KNOWN_PIECES = 1 << 17
BLOCK = 1 << 16  # bytes of texts; a block's arrays stay small enough for the JVM to drop them cheaply
LEARNT = 1 << 12  # pieces tokenised at once
ROWS = 64  # rows read as Python strings at once
#: Groups of more pairs of tokens than this are counted by distinct ids first.
WIDE = 64
_ODD = re.compile(r" (?:(?=\s|\Z)|(?<=\s ))")  # spaces that don't stand between two other characters, but for a first one
_SPLIT = re.compile(r"(?<=\S)(?= \S)")


class Plain(Vocabulary):
    """A, which takes the strings of added tokens as plain text.

    If ids ascend with the merges' ranks (and every token's own bytes give that token, as in any trained
    vocabulary), two neighbours whose bytes make a token are always those of its merge: no earlier merge went over the
    ends of their span, so within it all went as in the token alone. A merge by the bytes' ranks is the same then.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        added, self.added, self.split = set(self.added.values()), {}, None
        self.length = np.zeros(max(self.bytes_of) + 1, np.int32)
        self.length[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        ranks = {x: i for i, x in self.bytes_of.items() if i not in added}
        ascending = (np.diff(self.made) > 0).all() and len(ranks) == 256 + len(self.made)
        self.by_bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ascending else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.by_bytes is None:
            return self.encode(texts)
        run = self.by_bytes.encode_ordinary
        return [array("i", run(x)).tobytes() for x in texts]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of space + piece, end to end, and how many each piece has."""
        if self.by_bytes is not None and all(x and not x[0].isspace() and not x[-1].isspace() for x in pieces):
            # no token crosses the spaces between the pieces, so they are encoded at once
            ids = np.array(self.by_bytes.encode_ordinary(f" {' '.join(pieces)}"), np.int32)
            ends = np.cumsum(self.length[ids], dtype=np.int64)
            last = np.cumsum([1 + len(x.encode()) for x in pieces])
            at = np.searchsorted(ends, last)
            if len(pieces) and at[-1] < len(ends) and (ends[at] == last).all():
                return ids, np.diff(at, prepend=-1)
        own = self.encode_all([f" {x}" for x in pieces])
        return np.frombuffer(b"".join(own), np.int32), np.array([len(x) // 4 for x in own], np.int64)


class Numbers(dict):
    """Numbers the keys that are asked for, in order."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _picked(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists ``which`` end to end (list i lies from first[i] to first[i + 1]), and their lengths."""
    n = first[which + 1] - first[which]
    return np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Both:
    """The two tokenizers, and the tokens of the pieces met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Plain(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int32)
        self.piecewise = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in names)
        self.forget()

    def pieces(self, text: str) -> list[str]:
        """The text cut before single spaces; each piece stands for space + piece."""
        if not self.piecewise:
            return [text]
        if text[0] == " " or _ODD.search(text):
            first, *rest = _SPLIT.split(text)
            return [first, *(x[1:] for x in rest)]
        return text.split(" ")

    def forget(self) -> None:
        """Drops the pieces met so far: their numbers, and the ids and where each piece's begin, for A and B."""
        self.known = Numbers()
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.bad: set[str] = set()  # pieces that B doesn't give back
        self.a.known.clear()

    def learn(self) -> None:
        """The tokens of the pieces that have been numbered since."""
        have = len(self.first[0]) - 1
        new = list(islice(self.known, have, None))
        for at in range(0, len(new), LEARNT):
            part = new[at : at + LEARNT]
            two = self.b.encode(part, num_threads=1)
            flat = np.fromiter(chain.from_iterable(two), np.int32)
            for i, (ids, sizes) in enumerate((self.a.encode_pieces(part), (flat, np.fromiter(map(len, two), np.int64, len(two))))):
                self.ids[i] = np.concatenate([self.ids[i], ids])
                self.first[i] = np.concatenate([self.first[i], self.first[i][-1] + np.cumsum(sizes)])
            if b"".join(map(self.bytes_b.__getitem__, flat.tolist())) != "".join(f" {x}" for x in part).encode() or not self.same_ends(part, two):
                self.bad.update(x for x, b in zip(part, two, strict=True) if self.given_back(b) != f" {x}")

    def same_ends(self, pieces: list[str], ids: list[list[int]]) -> bool:
        sizes = self.length_b[np.fromiter(chain.from_iterable(ids), np.int32)]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.cumsum([len(x) for x in ids])]
        return bool((ends == np.cumsum([1 + len(x.encode()) for x in pieces])).all())

    def given_back(self, ids: list[int]) -> str | None:
        """The text of B's ids, null if it is none."""
        try:
            return b"".join(map(self.bytes_b.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return None

    def numbered(self, cut: list[list[str]]) -> np.ndarray:
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        self.learn()
        return flat

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
        """The dictionary (ids and ends of A and B, ends of pieces; ends begin with 0), the texts' pieces in it and where each text's end, and its numbers of tokens."""
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        cut = [self.pieces(x) if x else [] for x in texts]
        flat = self.numbered(cut)
        if self.bad:
            for i, own in enumerate(cut):
                if not self.bad.isdisjoint(own):  # no tokens, unless what differs in one piece is made up for by another
                    whole = self.ids[1][_picked(self.first[1], np.array([self.known[x] for x in own]))[0]].tolist()
                    cut[i] = [texts[i]] if self.given_back(whole) == f" {texts[i]}" else []
            flat = self.numbered(cut)
        used, order = np.unique(flat, return_inverse=True)
        a, b = ((self.ids[i][at], n) for i in (0, 1) for at, n in [_picked(self.first[i], used)])
        ends = [np.concatenate([[0], np.cumsum(n[ids], dtype=np.int64)]).astype(np.int32) for n, ids in ((self.a.length, a[0]), (self.length_b, b[0]))]
        last = np.concatenate([[0], np.cumsum(a[1])])
        offsets = np.cumsum([0, *map(len, cut)])
        counts = [np.diff(np.concatenate([[0], np.cumsum(n[order])])[offsets]) for n in (a[1], b[1])]
        return [a[0], ends[0], b[0], ends[1], ends[0][last]], order.astype(np.int32), offsets.astype(np.int32), counts


@cache
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """A row a block: ids, pieces (the documents', end to end), upto (where each document's end), na and nb (their numbers of tokens), and the dictionary as a, ea, b, eb, eu."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = both(path_a, path_b)

        def made(keys: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
            dictionary, pieces, upto, counts = own.block(texts)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([one(pa.concat_arrays(keys)), *(one(pa.array(x)) for x in (pieces, upto, *counts, *dictionary))], ["ids", "pieces", "upto", "na", "nb", "a", "ea", "b", "eb", "eu"])

        keys, texts, held = [], [], 0
        for batch in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            begin = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                texts.append(text or "")
                held += len(texts[-1])
                if held >= block_bytes:
                    yield made([*keys, batch.column("id").slice(begin, i + 1 - begin)], texts)
                    keys, texts, held, begin = [], [], 0, i + 1
            if begin < batch.num_rows:
                keys.append(batch.column("id").slice(begin))
        if texts:
            yield made(keys, texts)

    lists = ", ".join(f"{x} array<int>" for x in ("a", "ea", "b", "eb", "eu"))
    return source.mapInArrow(lean(run, lambda: both(path_a, path_b).forget()), f"ids array<{kind}>, pieces array<int>, upto array<int>, na array<bigint>, nb array<bigint>, {lists}")


def _places(some: str, every: str) -> Column:
    """The places in an ascending array of those of its values that ``some`` has, by a merge: the g-th value
    that the merged array has twice has the place k, of which g values are second ones."""
    merged = f"sort_array(concat({every}, {some}))"
    return F.expr(f"transform(array({merged}), m -> transform(filter(sequence(0, size(m) - 2), k -> m[k] = m[k + 1]), (k, g) -> k - g))[0]")


def _names(n: int, *ends: str) -> pa.Array:
    """The decimal numbers below n, each with each of the ends."""
    return pa.array([f"{i}{x}" for i in range(n) for x in ends])


@cache
def _tables(n_a: int, n_b: int) -> pa.Array:
    """How ids are written: 2 * a, plus 1 if a is the last of its group; then 3 * b, plus 1 as the last of a group, 2 as the last of a piece."""
    return pa.concat_arrays([_names(n_a, ",", "|"), _names(n_b, ",", ";", "")])


def _joined(values: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), between)


def _piece_texts(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, iu: np.ndarray) -> pa.Array:
    """The groups of each piece as text."""
    n_a, n_b = (1 << int(x.max(initial=0)).bit_length() for x in (a, b))  # so that few tables are made
    of_a, of_b = (np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in (ia, ib))
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ia[1:] - 1] = 1
    last_b[ib[1:] - 1] = 1
    last_b[ib[iu[1:]] - 1] = 2
    codes = np.empty(len(a) + len(b), np.int32)  # group by group, A's ids before B's
    codes[np.arange(len(a)) + ib[of_a]] = 2 * a + last_a
    codes[np.arange(len(b)) + ia[of_b + 1]] = 2 * n_a + 3 * b + last_b
    return _joined(_tables(n_a, n_b).take(pa.array(codes)), ia[iu] + ib[iu], "")


def _piece_links(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, iu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, n) of the linked ids, piece by piece, and where each piece's begin."""
    ka, kb = np.diff(ia), np.diff(ib)
    size = ka * kb
    piece = np.repeat(np.arange(len(iu) - 1), np.diff(iu))
    few = np.flatnonzero(size <= WIDE)
    g = np.repeat(few, size[few])
    at = np.arange(len(g)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    owner, pair, n = [piece[g]], [(a[ia[g] + at // kb[g]] << 32) + b[ib[g] + at % kb[g]]], [np.ones(len(g), np.int64)]
    for w in np.flatnonzero(size > WIDE).tolist():
        (x, nx), (y, ny) = (np.unique(ids[i[w] : i[w + 1]], return_counts=True) for ids, i in ((a, ia), (b, ib)))
        pair.append(((x << 32)[:, None] + y).ravel())
        n.append((nx[:, None] * ny).ravel())
        owner.append(np.full(len(pair[-1]), piece[w]))
    owner, pair, n = map(np.concatenate, (owner, pair, n))
    order = np.argsort(owner, kind="stable")
    return pair[order], n[order], np.searchsorted(owner[order], np.arange(len(iu)))


def _documents(row: dict[str, pa.Array]) -> pa.RecordBatch:
    """What ``align`` says of each document of a block."""
    own = {c: x.to_numpy().astype(np.int64) for c, x in row.items() if c != "ids"}
    dictionary = [own[c] for c in ("a", "b", "ia", "ib", "iu")]
    pieces, upto, iu = own["pieces"], own["upto"], own["iu"]
    texts = _joined(_piece_texts(*dictionary).take(row["pieces"]), upto, ";")
    n_groups = np.diff(np.concatenate([[0], np.cumsum(np.diff(iu)[pieces])])[upto])
    pair, n, first = _piece_links(*dictionary)
    pair, code = np.unique(pair, return_inverse=True)
    key, times = np.unique((np.repeat(np.arange(len(upto) - 1), np.diff(upto)) << 32) + pieces, return_counts=True)
    at, each = _picked(first, key & 0xFFFFFFFF)  # the links of each distinct piece of each document
    key = (np.repeat(key >> 32, each) << 32) + code[at]
    order = np.argsort(key)
    key, sums = key[order], np.concatenate([[0], np.cumsum((np.repeat(times, each) * n[at])[order])])
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    edges = np.searchsorted(key[begin], np.arange(len(upto)) << 32)
    links = pa.StructArray.from_arrays([pa.array(pair[key[begin] & 0xFFFFFFFF]), pa.array(np.diff(sums[[*begin, len(key)]]))], ["pair", "n"])
    n_links = np.diff(sums[np.append(begin, len(key))[edges]])
    columns = [row["ids"], row["na"], row["nb"], pa.array(n_groups), pa.array(n_links), texts, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), links)]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """For each row: id, n_a, n_b, n_groups, n_links, the groups as text and the links.

    ``groups`` is `a1,a2|b1;a3|b2,b3`, ids in order; ``links`` has a struct (pair, n) for each pair of
    linked ids, pair = a * 2**32 + b, n being how often it occurs. Without tokens both are empty.
    """
    df = tokens(docs, path_a, path_b, id_col, text_col, block_bytes).withColumn("cuts", F.array_intersect("ea", "eb"))
    # group g + 1 has the tokens ia[g] to ia[g + 1] of A and ib[g] to ib[g + 1] of B, ends exclusive; piece u + 1 the groups iu[u] to iu[u + 1]
    df = df.select("ids", "pieces", "upto", "na", "nb", "a", "b", _places("cuts", "ea").alias("ia"), _places("cuts", "eb").alias("ib"), _places("eu", "cuts").alias("iu"))
    kind = df.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents({c: batch.column(c)[i].values for c in batch.schema.names})

    whole = df.mapInArrow(lean(run), f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<struct<pair:bigint,n:bigint>>")
    return whole.withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n_docs, best) from a column ``links``: how many rows link the pair, and whether no pair of the same A id has more."""
    counts = links.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, most_broadcast: int = 1 << 19) -> DataFrame:
    """The rows of ``aligned`` without their links, with n_best and count_sum.

    Both inputs should be stored tables. The most frequent pairs, at most most_broadcast of them, are
    broadcast (their number is checked); rows of the other pairs are joined by a shuffle.
    """
    classes = counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("c")).count().orderBy(F.desc("c")).collect()  # at most 63 rows
    least, held = None, 0  # the lowest class that is broadcast
    for c, n in classes:
        held += n
        if held > most_broadcast:
            break
        least = c
    others = [c for c in aligned.columns if c != "links"]
    rows = aligned.withColumn("row", F.monotonically_increasing_id()).select(F.struct(*others).alias("own"), "row", F.explode_outer("links").alias("x")).select("own", "row", F.col("x.pair").alias("pair"), "x.n")
    if least is None and classes:
        found = rows.join(counts, "pair", "left")
    else:
        found = rows.join(F.broadcast(counts.filter(F.col("n_docs") >= F.lit(2 ** (least or 0)))), "pair", "left")
        if held > most_broadcast:
            rest = found.filter("n_docs is null").drop("n_docs", "best").join(counts.filter(F.col("n_docs") < F.lit(2**least)), "pair", "left")
            found = found.filter("n_docs is not null").unionByName(rest)
    sums = found.groupBy("own", "row").agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("n_docs")), F.lit(0)).cast("long").alias("count_sum"),
    )
    return sums.select("own.*", "n_best", "count_sum")


def op13_align(spark, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: tokens, groups and links of the two tokenizers, and what the links' corpus-wide counts say of them."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_a, path_b)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    kept = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"))
    return scored(kept, stored(pair_counts(kept)))

"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens that a task hasn't met yet are encoded together: an index maps each
mergeable pair to all its positions in them, the ranks that have positions are applied in
ascending order, and each merge updates only the lists of the neighbouring pairs. So the work
follows the number of merges and not the vocabulary.

The vocabulary file (a tokenizers JSON file without normalizer) is read on each executor from
the given path. Null and empty texts have no ids and decode to the empty text. Added tokens of
the file are matched in the text, as the library does. Texts are encoded whole, whatever their
length; columns that are not named are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import appended, chunks, lean, list_array

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
CACHE_WORDS = 1 << 17
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and token bytes of one file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_alphabet()
        model = data["model"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1 and i not in self.added.values()}
        self.first = np.array([single[b] for b in range(256)], np.int64)
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            merges[model["vocab"][x] << 32 | model["vocab"][y]] = (rank, model["vocab"][x + y])
        self.pairs = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[p][0] for p in self.pairs.tolist()] + [NEVER], np.int64)
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.doubled = np.zeros(len(model["merges"]), bool)  # the pair is of one symbol
        for p, (rank, new) in merges.items():
            self.made[rank], self.doubled[rank] = new, p >> 32 == p & 0xFFFFFFFF
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER if it isn't merged."""
        key = x << 32 | y
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return self.ranks[np.where(self.pairs[at] == key, at, len(self.pairs))] if len(self.pairs) else np.full(len(key), NEVER)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (as int32 bytes), by one pair occurrence index over all of them."""
        data = [w.encode() for w in words]
        sizes = np.array([len(w) for w in data], np.int64)
        ends = np.cumsum(sizes)
        ids = self.first[np.frombuffer(b"".join(data), np.uint8)]
        n = len(ids)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[(ends - sizes)[sizes > 0]] = -1
        after[ends[sizes > 0] - 1] = -1
        rank = np.full(n + 1, NEVER)  # of the pair that begins at each position; [-1] is a stopper
        have = np.flatnonzero(after >= 0)
        rank[have] = self.rank_of(ids[have], ids[after[have]])
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(where: np.ndarray) -> None:
            """List the positions under the ranks of their pairs."""
            where = where[rank[where] != NEVER]
            if not len(where):
                return
            where = where[np.argsort(rank[where], kind="stable")]
            r = rank[where]
            edges = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for k, low, high in zip(r[edges[:-1]].tolist(), edges, edges[1:], strict=False):
                if k in places:
                    places[k].append(where[low:high])
                else:
                    places[k] = [where[low:high]]
                    heapq.heappush(active, k)

        index(have)
        while active:
            k = heapq.heappop(active)
            lists = places.pop(k)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[rank[i] == k]
            if self.doubled[k] and len(i) > 1:  # of neighbours in a row, the first, third, ... merge
                i = np.unique(i)  # a position may be listed twice
                new = np.concatenate([[True], after[i[:-1]] != i[1:]])
                start = np.flatnonzero(new)
                i = i[(np.arange(len(i)) - start[np.cumsum(new) - 1]) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            nxt = after[j]
            ids[i], ids[j], after[i] = self.made[k], -1, nxt
            rank[i], rank[j] = NEVER, NEVER
            more = nxt >= 0
            before[nxt[more]] = i[more]
            behind = before[i]
            behind = behind[behind >= 0]
            touched = np.concatenate([i[more], behind[after[behind] >= 0]])
            touched = touched[ids[touched] >= 0]
            rank[touched] = self.rank_of(ids[touched], ids[after[touched]])
            index(np.unique(touched) if self.doubled[k] else touched)
        alive = ids >= 0
        count = np.concatenate([[0], np.cumsum(alive)]) * 4
        body = ids[alive].astype(np.int32).tobytes()
        return [body[x:y] for x, y in zip(count[ends - sizes].tolist(), count[ends].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        parts = []
        for text in texts:
            find = self.ascii_words.findall if text.isascii() else self.words.findall
            if self.split is None or not any(s in text for s in self.added):
                parts.append(find(text))
            else:
                parts.append([w for i, piece in enumerate(self.split.split(text)) for w in ([piece] if i % 2 else find(piece))])
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if not self.known:
            self.known.update({s: np.int32(i).tobytes() for s, i in self.added.items()})
        known = self.known
        if new := list(set().union(*parts).difference(known)):
            known.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join(map(known.__getitem__, ws)) for ws in parts]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    """Keys and ids (as a column and one by one) of the rows of id and text."""
    own = vocabulary(path)
    for batch in batches:
        for part in chunks(batch, "text"):
            ids = [np.frombuffer(x, np.int32) for x in own.encode([x or "" for x in part.column("text").to_pylist()])]
            yield part.column("id"), list_array(ids, pa.int32()), ids


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; no special tokens are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, _ in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([key, ids], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    # a task's known words are dropped at its end
    return source.mapInArrow(lean(run, lambda: vocabulary(path).known.clear()), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "decoded") -> DataFrame:
    """(id, ids, the text that the ids decode to) for each row, as decode(encode(docs)) gives them.

    Both steps run in one Python worker a core, where the two functions in a row take two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(path).bytes_of.__getitem__
        for key, ids, lists in _encoded(batches, path):
            texts = [b"".join(map(get, x.tolist())).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([key, ids, pa.array(texts, pa.string())], ["id", "ids", out])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(run, lambda: vocabulary(path).known.clear()), f"id {kind}, ids array<int>, `{out}` string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; bytes that are no UTF-8 become U+FFFD. Null decodes to ''.

    A column of the name ``out`` is replaced.
    """
    kept = appended(encoded, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(path).bytes_of.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(at)
                others = [part.column(part.schema.get_field_index(c)) for c in kept]
                flat = (column.fill_null([]) if column.null_count else column).flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum(pc.coalesce(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
                texts = [b"".join(map(get, flat[x:y])).decode("utf-8", "replace") for x, y in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], [*kept, out])

    return encoded.mapInArrow(lean(run), "".join(f"{x}, " for x in kept.values()) + f"`{out}` string")


def op3_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode_decode(docs, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct w-word shingles, kept in one global order: the class of
a token (how frequent it is), then the frequency of its words, then its hash. Two linked documents, whose shared part is at
least num/den of their union, differ in at most d(n) = floor(n * (den - num) / num) tokens,
n being either's size. Hence, with both token lists sorted,

* they share one of the first n - ceil(n * num / den) + 1 tokens of each (the base prefix);
* they share k tokens that stand next to each other in both lists, within the first
  k * d(n) + k tokens (the extended prefix), since each foreign token breaks at most k of the
  runs of k neighbours.

Rare tokens of the base prefix are indexed alone. A document with a frequent token in its base
prefix also indexes its runs of k neighbours: a shared frequent token alone never makes
candidates. Any order keeps this complete; classes and word counts only decide the cost. Tokens of
rare words come first, as they hardly ever meet by chance.

A bucket's members are first compared with the bucket's smallest id, their leader; members of
one leader that still belong to several components are then compared across components only, by
their sketches, the coarse and then the dense ones, and in blocks. So a group of n copies costs about n verifications. Candidates that pass
a bound computed from parity sketches, a coarse one first, are verified exactly on the whole texts.
Documents with equal token sets count as one from the start.

Nulls, empty texts and texts without words have no tokens and link with nothing. Repeated ids
give one result row for each input row. Columns other than the id and the text are ignored,
whatever their names. An empty table gives an empty result. Texts and words are read whole, whatever
their length. Ties don't arise: a component's name is its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.graph import components
from docengine.llm.sieve import parted, sieved
from docengine.llm.words import chunks, lean, list_array, mixed, shingle_hashes, shingle_sets, word_hashes
from docengine.session import cut

CLASS_BITS, WORD_BITS = 20, 15
BLOCK, FEW, TRIES = 1024, 16, 4
# a token's place in the global order: 5 bits of class, 10 of its words' frequency, 49 of hash
_CLASS_AT, _WORDS_AT = np.uint64(59), np.uint64(49)
_SHARE = "id long, n int, h1 long, h2 long, keys array<long>, coarse array<long>, sketch array<long>"


def run_length(num: int, den: int, most: int = 3) -> int:
    """The longest run of neighbours that every two different linked sets must share."""
    for k in range(most, 1, -1):
        if all(n - k + 1 > k * (n * (den - num) // num) for n in range(num // (den - num), 4096) if n * (den - num) >= num):
            return k
    return 1


def _statistics(docs: DataFrame, size: int, chunk_tokens: int, at_least: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each hashed token, and four times the binary logarithm of each hashed word's count.

    Each task counts all tokens of its rows exactly, in chunks, and passes on those that occur
    at_least times within a chunk; sums of total or more set the class (0, or the logarithm of
    the sum). Words are counted by their slot. The tables have 2**CLASS_BITS and 2**WORD_BITS
    entries whatever the input.
    """
    slots = np.uint64((1 << WORD_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        words = np.zeros(1 << WORD_BITS, np.int64)

        def rows(keys: np.ndarray, counts: np.ndarray, word: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "token", "n"])

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= at_least
            return rows(values[keep], counts[keep], False)

        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, starts = word_hashes(part.column("text"))
                words += np.bincount((hashes & slots).astype(np.int64), minlength=1 << WORD_BITS)
                values, bounds = shingle_hashes(hashes, starts, size)
                held += [np.unique(values[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
                n += len(values)
                if n >= chunk_tokens:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        seen = np.flatnonzero(words)
        yield rows(seen, words[seen], True)

    found = docs.select("text").mapInArrow(lean(count), "word boolean, token long, n long").groupBy("word", "token").agg(F.sum("n").alias("n")).filter(F.col("word") | (F.col("n") >= total))
    slot = F.when(F.col("word"), F.col("token")).otherwise(F.expr(f"pmod(token, {1 << CLASS_BITS})"))
    top = found.groupBy("word", slot.cast("int").alias("slot")).agg(F.max(F.log2("n")).alias("c"))
    classes, rarity = np.zeros(1 << CLASS_BITS, np.uint8), np.zeros(1 << WORD_BITS, np.uint64)
    for row in top.toLocalIterator():  # at most as many rows as the tables have entries
        if row.word:
            rarity[row.slot] = int(4 * row.c)
        else:
            classes[row.slot] = min(int(row.c), 31)
    return classes, rarity


def _half(x: np.ndarray) -> np.ndarray:
    return x[: len(x) // 2] ^ x[len(x) // 2 :]


def parity_sketch(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit per slot: whether it holds an odd number of tokens; a power of two of slots, four or more for each token.

    With so many, few tokens share a slot, and sets just below the threshold are told apart. Two
    sets' sketches differ in at most as many bits as the sets differ in tokens, also after
    folding the longer onto the shorter. The first of the two results is such a folded one, with
    an eighth of the slots, which is enough to tell sets of little in common apart.
    """
    slots = 64
    while slots < 4 * len(tokens):
        slots *= 2
    odd = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    sketch = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    coarse = sketch
    while len(coarse) > max(1, len(sketch) // 8):
        coarse = _half(coarse)
    return coarse, sketch


def _indexed(docs: DataFrame, size: int, num: int, den: int, classes: np.ndarray, rarity: np.ndarray) -> DataFrame:
    """Per row: size and digests of its token set, keys (single tokens and runs), sketches."""
    k = run_length(num, den)
    held = docs.sparkSession.sparkContext.broadcast((classes, rarity))
    mask, slots = np.uint64((1 << CLASS_BITS) - 1), np.uint64((1 << WORD_BITS) - 1)
    fields = ("id", "n", "h1", "h2", "keys", "coarse", "sketch")

    def places(values: np.ndarray, common: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Distinct tokens' places in the global order, ascending; equal tokens have equal words."""
        tokens, at = np.unique(values, return_index=True)
        kind = table[tokens & mask].astype(np.uint64)
        return tokens, np.sort((kind << _CLASS_AT) | (common[at] << _WORDS_AT) | (mixed(tokens) >> np.uint64(15)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = held.value
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, h1, h2, keys, coarse, sketches = [], [], [], [], [], []
                words, rows = word_hashes(part.column("text"))
                values, bounds = shingle_hashes(words, rows, size)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(often[words & slots], dtype=np.uint64)])
                first = np.repeat(rows[:-1] - bounds[:-1], np.diff(bounds)) + np.arange(len(values))
                last = np.minimum(first + size, np.repeat(rows[1:], np.diff(bounds)))
                common = np.minimum(sums[last] - sums[first], np.uint64(1023))
                for x, y in zip(bounds, bounds[1:], strict=False):
                    tokens, order = places(values[x:y], common[x:y], table)
                    n = len(tokens)
                    counts.append(n)
                    spread = mixed(tokens)
                    h1.append(int(np.bitwise_xor.reduce(spread)) if n else 0)
                    h2.append(int(spread.sum()) if n else 0)
                    for to, sketch in zip((coarse, sketches), parity_sketch(spread), strict=True):
                        to.append(sketch)
                    p = n + (-n * num // den) + 1 if n else 0
                    base = order[:p]
                    single = base[base >> _CLASS_AT == 0]
                    if len(single) < p:
                        ext = order[: k * (n * (den - num) // num) + k]
                        run = np.zeros(max(0, len(ext) - k + 1), np.uint64)
                        for j in range(k):
                            run = mixed(run + ext[j : j + len(run)])
                        single = np.concatenate([single, run | np.uint64(1 << 63)])
                    keys.append(single)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h1, h2)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int32()), *signed, *map(list_array, (keys, coarse, sketches))], fields)

    return docs.select("id", "text").mapInArrow(lean(index), _SHARE)


def _apart(x: str, y: str) -> str:
    """SQL for the number of bits in which two sketches differ; the longer is folded onto the shorter."""
    # linked sizes differ by less than a factor of two, and so do their sketches
    folded = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    return f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (t, c) -> t + c)"


def _close(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (checkpointed ones) that the sizes and the parity sketches don't rule out, the coarse ones first.

    Only the rows that pairs name leave their tasks.
    """
    ids = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
    few = sieved(reps.select("id", "n", "coarse"), ids(pairs), "id")
    sizes = lambda x: few.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("coarse").alias(f"c{x}"))
    within = f"{{}} * {num} <= least(na, nb) * {den - num}"
    pairs = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(f"least(na, nb) * {den}L >= greatest(na, nb) * {num}L")
    pairs = cut(pairs.filter(within.format(_apart("ca", "cb"))).select("a", "b", "na", "nb"))
    fewer = sieved(reps.select("id", "sketch"), ids(pairs), "id")
    side = lambda x: fewer.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", F.expr(f"cast({_apart('sa', 'sb')} as int)"))
    return both.filter(within.format("apart")).select("a", "b", "apart")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of sketches, and where each row's begin and the last one's end."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])


def _coarse(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coarse sketches of dense ones, in the same form."""
    length = np.diff(edges)
    to = np.concatenate([[0], np.cumsum(np.maximum(1, length // 8))])
    out = np.zeros(to[-1], np.uint64)
    for s in np.unique(length).tolist():
        own, short = np.flatnonzero(length == s), max(1, s // 8)
        out[to[own][:, None] + np.arange(short)] = np.bitwise_xor.reduce(flat[edges[own][:, None] + np.arange(s)].reshape(len(own), -1, short), axis=1)
    return out, to


def _near(flat: np.ndarray, edges: np.ndarray, i: np.ndarray, k: np.ndarray, least: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (i, k) of rows their sketches don't rule out; least is the smaller size. The longer sketch is folded onto the shorter."""
    length = np.diff(edges)
    fine = np.zeros(len(i), bool)
    for s in np.unique(np.minimum(length[i], length[k])).tolist():
        own = np.flatnonzero(np.minimum(length[i], length[k]) == s)
        for at in range(0, len(own), step := max(1, (1 << 20) // s)):
            part = own[at : at + step]
            apart = np.zeros((len(part), s), np.uint64)
            for rows in (i[part], k[part]):
                for fold in range(int(length[rows].max()) // s):
                    has = length[rows] > fold * s
                    apart[has] ^= flat[edges[rows[has]][:, None] + fold * s + np.arange(s)]
            fine[part] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) * num <= least[part] * (den - num)
    return np.flatnonzero(fine)


def _across(placed: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one leader from different components that sizes and sketches don't rule out.

    Leaders with few members are joined; the members of others are dealt into blocks of about
    BLOCK rows, and each pair of blocks is compared by one vectorised call, so neither pairs nor
    whole groups are ever rows of one task.
    """
    size = placed.groupBy("leader").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).filter("c0 < c1").select("leader", "m")
    rows = cut(placed.join(size, "leader"))
    few = rows.filter(F.col("m") <= FEW)
    left, right = (few.select("leader", F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    small = left.join(right, "leader").filter("a > b and ca <> cb").select("a", "b")

    many = rows.filter(F.col("m") > FEW)
    many = many.join(sieved(reps.select("id", "n", "sketch"), many.select("id"), "id"), "id").withColumn("nb", F.ceil(F.col("m") / BLOCK))
    many = many.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    many = many.select("leader", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "id", "c", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        ids, c, n, blk = (table.column(x).to_numpy() for x in ("id", "c", "n", "blk"))
        same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        dense, at_dense = _flat(table.column("sketch"))
        flat, edges = _coarse(dense, at_dense)
        length = np.diff(edges)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in np.unique(length):
            own = np.flatnonzero(length == s)
            twice = np.flatnonzero(length == 2 * s)
            x = flat[edges[own][:, None] + np.arange(s)]
            folded = [flat[edges[twice][:, None] + np.arange(s)] ^ flat[edges[twice][:, None] + s + np.arange(s)]] if len(twice) else []
            other, y = np.concatenate([own, twice]), np.concatenate([x, *folded])
            step = max(1, (1 << 21) // (len(other) * int(s)))
            for at in range(0, len(own), step):
                i = own[at : at + step]
                apart = np.bitwise_count(x[at : at + step][:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                low, high = np.minimum(n[i][:, None], n[other][None, :]), np.maximum(n[i][:, None], n[other][None, :])
                fine = (apart * num <= low * (den - num)) & (low * den >= high * num) & (c[i][:, None] != c[other][None, :])
                if not same:
                    fine &= blk[i][:, None] != blk[other][None, :]
                r, k = np.nonzero(fine)
                near = _near(dense, at_dense, i[r], other[k], np.minimum(n[i[r]], n[other[k]]), num, den)
                found.append((ids[i[r[near]]], ids[other[k[near]]]))
        a, b = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    large = many.groupBy("leader", "p", "q").applyInArrow(compare, "a long, b long")
    return _close(cut(small.unionByName(large).distinct()), reps, num, den)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole shingle sets reach num/den."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # an inner join: a semi join would be moved below the sieve
    texts = sieved(docs.select("id", "text"), needed, "id").join(needed, "id")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ta"):
                keep = []
                for x, y in zip(shingle_sets(part.column("ta"), size), shingle_sets(part.column("tb"), size), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * shared >= num * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(lean(verify), "a long, b long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5, chunk_tokens: int = 1 << 20, at_least: int = 16, total: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) for every row; see the module's docstring.

    size: words a shingle; num/den: least Jaccard similarity. chunk_tokens, at_least and total
    say when a token counts as frequent and have no influence on the result.
    """
    if not den < 2 * num < 2 * den:
        raise ValueError("the similarity must lie between one half and 1")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    indexed = cut(_indexed(docs, size, num, den, *_statistics(docs, size, chunk_tokens, at_least, total)))
    known = indexed.filter("n > 0 and id is not null")
    sets = cut(known.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("m")))
    # of equal sets, the smallest id stands for all; it is also the smallest in any bucket of theirs
    firsts = sets.select(F.col("rep").alias("id")).distinct()
    odd = cut(known.groupBy("id").count().join(firsts.withColumn("first", F.lit(True)), "id", "left").filter("count > 1 or first is null").select("id"))
    sure, maybe = parted(known.select("id", "n", "coarse", "sketch"), odd, "id", 24)
    maybe = maybe.join(firsts, "id", "left_semi").groupBy("id").agg(F.min("n").alias("n"), F.min("coarse").alias("coarse"), F.min("sketch").alias("sketch"))
    reps = cut(sure.unionByName(maybe))
    keys = indexed.filter("id is not null").select("id", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low"))
    buckets = sieved(keys, shared, "key", 24).join(shared, "key").join(reps.select("id"), "id")
    stars = cut(buckets.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    links = cut(_verified(cut(_close(stars, reps, num, den).select("a", "b")), docs, size, num, den))
    groups = cut(components(links))

    # members of one bucket have its smallest id as their leader, so pairs of one leader include all candidates
    placed = stars.select(F.col("b").alias("leader"), F.col("a").alias("id")).join(groups, "id", "left").select("leader", "id", F.coalesce("component", "id").alias("c"))
    cross = cut(_across(placed, reps, num, den))
    # one link joins two components: each component first tries its nearest candidates, then what still lies between components is verified
    named = cross
    for x in "ab":
        named = named.join(groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    nearest = Window.partitionBy(F.greatest("ca", "cb")).orderBy("apart", "a", "b")
    ranked = cut(named.withColumn("rank", F.row_number().over(nearest)).select("a", "b", "rank"))
    links = cut(links.unionByName(_verified(ranked.filter(F.col("rank") <= TRIES).select("a", "b"), docs, size, num, den)))
    groups = cut(components(links))
    rest = ranked.filter(F.col("rank") > TRIES).select("a", "b")
    for x in "ab":
        rest = rest.join(groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    more = cut(_verified(cut(rest.filter("ca <> cb").select("a", "b")), docs, size, num, den))
    groups = components(links.unionByName(more))

    # rows of a set that holds over a 1024th of all rows, of which there are fewer than 1024, are answered where they are
    limit = (sets.agg(F.sum("m")).first()[0] or 0) // 1024
    named = sets.select("n", "h1", "h2", "rep", "last", "m").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("n", "h1", "h2", F.coalesce("component", "rep").alias("c"), "rep", "last", "m")
    hot = named.filter(F.col("m") > limit).select("n", "h1", "h2", F.col("c").alias("hot"))
    some = indexed.filter("n > 0").select("id", "n", "h1", "h2").join(F.broadcast(hot), ["n", "h1", "h2"], "left")
    cold = named.filter((F.col("m") <= limit) & ((F.col("rep") < F.col("last")) | (F.col("c") < F.col("rep"))))
    rest = some.filter("hot is null").join(cold.select("n", "h1", "h2", "c"), ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    out = rest.unionByName(some.filter("hot is not null").select("id", "n", F.col("hot").alias("c"))).unionByName(indexed.filter("n = 0").select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_join(docs, size=4, num=85, den=100)


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(r.c AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

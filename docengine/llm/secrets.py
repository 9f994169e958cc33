"""Secret scan with linking of multipart credentials, in DataFrame operations only.

Base spans (assign, access, hex) are strong and always reported. Weak parts (mail-like account
names, endpoints, random-looking runs) are reported only if a complementary part lies within
``reach`` characters in the same document:

* a weak secret needs an identifier or an endpoint nearby,
* an account name or an endpoint needs a secret nearby.

The parts are joined as intervals: each is listed under the blocks of the document that it
touches (a weak part also under those within reach), and parts of one block are compared.

Positions are code points, ends exclusive. A null text counts as empty and has no spans.
Repeated rows get equal results; rows with one id and different texts are told apart by the
texts' hashes. Texts are scanned whole. Columns that are not named are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.sieve import whole
from docengine.session import cut

# The kinds, in order, and their patterns.
KINDS = ["assign", "access", "hex", "weak_secret", "account", "endpoint"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_SECRET = r"[A-Za-z0-9+/_-]{32,}"
ACCOUNT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
ENDPOINT = r"[a-z][a-z0-9+]+://[A-Za-z0-9._:/?#%&=-]{3,}"
# the same matches in time linear in a run: they begin where a run does or where the last match ended
ACCOUNT_ONCE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
ENDPOINT_ONCE = r"(?:\G|(?<![a-z]))[a-z][a-z0-9+]++://[A-Za-z0-9._:/?#%&=-]{3,}+"

_SPAN = "struct<start:int,kind:int,end:int>"
_BLOCK = 4096


def _found(text: str, pattern: str, kind: int, gate: Column, keep: str = "true") -> Column:
    """The matches of a pattern as an array of spans; ``keep`` sees a match as x.m and x.g."""
    literal = "r'" + pattern.replace("'", r"\x27") + "'"
    group = 2 if kind == 0 else 0
    walked = F.expr(
        f"""filter(aggregate(
            zip_with(split({text}, {literal}, -1),
                zip_with(regexp_extract_all({text}, {literal}, 0), regexp_extract_all({text}, {literal}, {group}), (m, g) -> struct(m as m, g as g)),
                (s, x) -> struct(s as s, x.m as m, x.g as g)),
            struct(0 as at, cast(array() as array<struct<start:int,kind:int,end:int,ok:boolean>>) as out),
            (a, x) -> struct(a.at + length(x.s) + length(coalesce(x.m, '')) as at,
                concat(a.out, array(struct(a.at + length(x.s) as start, {kind} as kind, a.at + length(x.s) + length(coalesce(x.m, '')) as end, x.m is not null and {keep} as ok))) as out),
            a -> a.out), x -> x.ok)"""
    )
    slim = F.transform(walked, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(gate, slim).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base, weak) for each row: h tells texts apart, base and weak are arrays of spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("h", F.xxhash64("t"))
    t = F.col("t")
    df = df.select(
        "*",
        F.concat(
            _found("t", ASSIGN, 0, t.rlike(ASSIGN), "length(x.g) >= 6"),
            _found("t", ACCESS, 1, t.contains("AKIA") & t.rlike(ACCESS)),
            _found("t", HEX, 2, t.rlike(HEX)),
        ).alias("base"),
        F.concat(_found("t", ACCOUNT_ONCE, 4, t.contains("@")), _found("t", ENDPOINT_ONCE, 5, t.contains("://"))).alias("near"),
    )
    # a run is weak if it mixes letters and digits and no base span overlaps it
    runs = _found("t", WEAK_SECRET, 3, (F.size("near") > 0) | F.exists("base", lambda b: b["kind"] == 1), "x.m rlike '[0-9]' and x.m rlike '[A-Za-z]'")
    runs = F.filter(runs, lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return df.select("id", "h", F.sort_array("base").alias("base"), F.concat(runs, "near").alias("weak"))


def _role(kind: str) -> str:
    return f"case when {kind} in (0, 2, 3) then 'secret' when {kind} in (1, 4) then 'identifier' else 'endpoint' end"


def linked(found: DataFrame, reach: int = 200) -> DataFrame:
    """The weak spans of ``parts`` that have a complementary part within reach: (id, h, span)."""
    some = found.filter("size(weak) > 0").select("id", "h", "base", "weak").distinct()
    every = some.select("id", "h", F.explode(F.concat("base", "weak")).alias("p"))
    every = every.select("id", "h", F.col("p").alias("q"), F.explode(F.expr(f"sequence(p.start div {_BLOCK}, p.end div {_BLOCK})")).alias("block"), F.expr(_role("p.kind")).alias("other"))
    weak = some.select("id", "h", F.explode("weak").alias("p"))
    weak = weak.select("id", "h", "p", F.explode(F.expr(f"sequence(greatest(p.start - {reach}, 0) div {_BLOCK}, (p.end + {reach}) div {_BLOCK})")).alias("block"), F.expr(_role("p.kind")).alias("role"))
    close = f"w.id <=> e.id and w.h = e.h and w.block = e.block and q.start < p.end + {reach} and p.start - {reach} < q.end"
    complement = "(role = 'secret' and other <> 'secret' or role <> 'secret' and other = 'secret')"
    joined = weak.alias("w").join(every.alias("e"), F.expr(f"{close} and {complement}"), "left_semi")
    return joined.select("id", "h", F.col("p").alias("span")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(id, h, base, spans) for each row: the base spans and all reported spans, by start and kind."""
    found = cut(parts(docs, id_col, text_col))  # narrow rows without the texts, which are so matched once
    extra = linked(found, reach).groupBy("id", "h").agg(F.collect_list("span").alias("extra"))  # bounded by one text
    out = found.alias("f").join(extra.alias("x"), F.expr("f.id <=> x.id and f.h = x.h"), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    return out.select(F.col("f.id").alias(id_col), "f.h", "base", spans.alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """The documents, each reported span of the text replaced by the mark; overlapping spans by one."""
    found = scan(docs, id_col, text_col, reach).filter("size(spans) > 0").select(F.col(id_col).alias("found_id"), F.col("h").alias("found_h"), "spans").distinct()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(whole(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    both = keyed.join(found, F.expr("id <=> found_id and h = found_h"), "left")
    clean = F.expr(
        f"""aggregate(spans, struct(cast(array() as array<string>) as out, 0 as at),
            (a, x) -> if(x.start < a.at, struct(a.out as out, greatest(a.at, x.end) as at),
                struct(concat(a.out, array(substring(t, a.at + 1, x.start - a.at), '{mark}')) as out, x.end as at)),
            a -> concat(array_join(a.out, ''), substring(t, a.at + 1)))"""
    )
    at = F.col(f"row.`{text_col}`")
    return both.select(*[F.when(F.size("spans") > 0, clean).otherwise(at).alias(c) if c == text_col else F.col("row.`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def _duck(name: str, pattern: str, kind: int, keep: str = "true") -> str:
    q = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS kind, a AS start, a + length(m) AS "end" FROM (
      SELECT doc_id, ms[i] AS m, gs[i] AS g, CAST(list_sum(list_transform(ss[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM (SELECT doc_id, ms, gs, ss, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {q}) AS ms, regexp_extract_all(text, {q}, {2 if kind == 0 else 0}) AS gs, string_split_regex(text, {q}) AS ss FROM d))) WHERE {keep}"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_duck("assign", ASSIGN, 0, "length(g) >= 6")} UNION ALL {_duck("access", ACCESS, 1)} UNION ALL {_duck("hex", HEX, 2)}),
near AS ({_duck("account", ACCOUNT, 4)} UNION ALL {_duck("endpoint", ENDPOINT, 5)}),
runs AS (SELECT * FROM ({_duck("weak_secret", WEAK_SECRET, 3, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}) r
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r."end" AND r.start < b."end")),
weak AS (SELECT * FROM runs UNION ALL SELECT * FROM near), every AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM every e WHERE e.doc_id = w.doc_id
  AND e.start < w."end" + 200 AND w.start - 200 < e."end" AND (w.kind = 3) <> (e.kind IN (0, 2, 3)))),
names AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS kind, unnest({KINDS!r}) AS name),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end") AS s FROM base JOIN names USING (kind) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end") AS s FROM spans JOIN names USING (kind) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""

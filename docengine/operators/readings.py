"""Reconciling a page's native and recognised readings: one is kept where two read the same ink.

Two readings are of the same ink if their common part is at least half of the smaller box. In order, a
native reading is kept unless it is of the same ink as one kept before. An equal text is then a duplicate; another
text is a conflict, which takes both back: nothing decides between incompatible originals. A recognised reading gives way to
native ones: it is a duplicate of a single equal one, in conflict with any other, and withheld where natives are in
conflict. Those that meet no native reading are reconciled among themselves in the same way.

What is kept before is found by rounds: a reading without an open earlier neighbour is kept, and all that
meet it are not; so a round decides many readings of all pages at once, and only open ones go on. There are
as many rounds as the longest chain of readings each of which depends on the one before.

The smaller box's middle lies in the larger one. Boxes are listed under the cells that they touch in the grid
of their own size (a power of two), middles under their cell in each grid that occurs, so neighbours meet without all pairs of a page.

Columns: page, id (the order on a page; unique there for each source), source (native or ocr), x0, y0, x1, y1,
text, valid (of native text), hidden. Readings with a null box, without an area or with an empty text take no part. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import line_text
from docengine.session import cut

# Fixed value: the least part of the smaller box that two readings of the same ink share.
SAME_INK = 0.5
_SIZES = (-20, 20)  # binary classes of box sizes that are told apart


def ink_pairs(boxes: DataFrame) -> DataFrame:
    """(page, a, b) with a < b for all pairs of boxes (page, n, x0, y0, x1, y1) of the same ink."""
    class_of = F.greatest(F.least(F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int"), F.lit(_SIZES[1])), F.lit(_SIZES[0]))
    sized = boxes.withColumn("k", class_of)
    present = [r[0] for r in sized.select("k").distinct().orderBy("k").collect()]  # at most 41
    if not present:
        return boxes.sparkSession.createDataFrame([], f"page {dict(boxes.dtypes)['page']}, a {dict(boxes.dtypes)['n']}, b {dict(boxes.dtypes)['n']}")
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), "k")).cast("long")
    corners = ("x0", "y0", "x1", "y1")
    large = sized.select("page", "k", F.col("n").alias("a"), *[F.col(c).alias(f"o{c}") for c in corners])
    large = large.withColumn("cx", F.explode(F.sequence(cell(F.col("ox0")), cell(F.col("ox1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("oy0")), cell(F.col("oy1")))))
    small = boxes.withColumn("k", F.explode(F.array(*map(F.lit, present)))).withColumn("cx", cell((F.col("x0") + F.col("x1")) / 2)).withColumn("cy", cell((F.col("y0") + F.col("y1")) / 2))
    both = large.join(small.withColumnRenamed("n", "b"), ["page", "k", "cx", "cy"]).filter("a <> b")
    w = F.least("x1", "ox1") - F.greatest("x0", "ox0")
    h = F.least("y1", "oy1") - F.greatest("y0", "oy0")
    own, other = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("ox1") - F.col("ox0")) * (F.col("oy1") - F.col("oy0"))
    same = (w > 0) & (h > 0) & (w * h / F.least(own, other) >= SAME_INK)
    # each pair from the side of its smaller box; equal ones come twice
    return both.filter((own <= other) & same).select("page", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def kept_in_order(pairs: DataFrame) -> DataFrame:
    """(page, n) of the readings named in (page, a, b) that aren't kept, b coming after a: those that meet one kept before."""
    none = pairs.select("page", F.col("b").alias("n")).limit(0)
    open_, lost = cut(pairs), [none]
    while not open_.isEmpty():
        later = open_.select("page", F.col("b").alias("n")).distinct()
        first = open_.select("page", F.col("a").alias("n")).distinct().join(later, ["page", "n"], "left_anti")  # no open reading before them
        out = cut(open_.join(first.withColumnRenamed("n", "a"), ["page", "a"], "left_semi").select("page", F.col("b").alias("n")).distinct())
        lost.append(out)
        for side in "ab":
            open_ = open_.join(out.withColumnRenamed("n", side), ["page", side], "left_anti")
        # pairs whose earlier reading is kept have lost their later one, so what stays open is smaller
        open_ = cut(open_)
    out = lost[0]
    for x in lost[1:]:
        out = out.unionByName(x)
    return out


def _among(readings: DataFrame, pairs: DataFrame, conflict: str, duplicate: str, retained: str) -> DataFrame:
    """(page, n, kept, reason, taken_back): what the readings of one source say of each other, a row a reading and reason."""
    lost = cut(kept_in_order(pairs))
    key = readings.select("page", "n", "key")
    met = pairs.join(lost.withColumnRenamed("n", "b"), ["page", "b"], "left_semi").join(lost.withColumnRenamed("n", "a"), ["page", "a"], "left_anti")
    for side in "ab":
        met = met.join(key.select("page", F.col("n").alias(side), F.col("key").alias(f"key_{side}")), ["page", side])
    same = met.groupBy("page", "b").agg(F.bool_and(F.col("key_a") == F.col("key_b")).alias("same"))
    later = same.select("page", F.col("b").alias("n"), F.lit(False).alias("kept"), F.when(F.col("same"), duplicate).otherwise(conflict).alias("reason"), (~F.col("same")).alias("taken_back"))
    earlier = met.select("page", "a", "b").join(same, ["page", "b"]).select("page", F.col("a").alias("n"), F.lit(True).alias("kept"), F.when(F.col("same"), retained).otherwise(conflict).alias("reason"), (~F.col("same")).alias("taken_back")).distinct()
    return later.unionByName(earlier)


def reconciled(readings: DataFrame, include_hidden: bool = False) -> DataFrame:
    """(page, source, id, in_main, status, reasons) of every reading; status is selected or ambiguous, reasons are sorted."""
    boxed = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.coalesce("text", F.lit("")) != ""), F.lit(False))
    all_ = cut(readings.select("page", "source", "id", "x0", "y0", "x1", "y1", line_text(F.col("text")).alias("key"), boxed.alias("boxed"), F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("hidden", F.lit(False)).alias("hidden")).withColumn("n", F.col("id")))
    native = all_.filter("source = 'native' and boxed and valid" + ("" if include_hidden else " and not hidden"))
    ocr = all_.filter("source = 'ocr' and boxed")
    box = ("page", "n", "x0", "y0", "x1", "y1")
    # native readings come before recognised ones: 2 n and 2 n + 1 keep both orders in one column
    mixed = native.withColumn("n", F.col("n") * 2).select(*box).unionByName(ocr.withColumn("n", F.col("n") * 2 + 1).select(*box))
    pairs = cut(ink_pairs(mixed).select("page", (F.col("a") % 2).alias("ta"), (F.col("b") % 2).alias("tb"), F.expr("a div 2").alias("a"), F.expr("b div 2").alias("b")))

    of_native = cut(_among(native, pairs.filter("ta = 0 and tb = 0").select("page", "a", "b"), "NATIVE_TEXT_CONFLICT", "DUPLICATE_NATIVE_READING", "NATIVE_DUPLICATE_ALTERNATIVE_RETAINED"))
    disputed = of_native.filter("reason = 'NATIVE_TEXT_CONFLICT'").select("page", "n").distinct()
    out_of_main = of_native.filter("taken_back or not kept").select("page", "n").distinct()
    trusted = native.select("page", "n", "key").join(out_of_main, ["page", "n"], "left_anti")

    # a pair of both sources, the native reading as n and the recognised one as o
    across = pairs.filter("ta <> tb").select("page", F.when(F.col("ta") == 0, F.col("a")).otherwise(F.col("b")).alias("n"), F.when(F.col("ta") == 1, F.col("a")).otherwise(F.col("b")).alias("o"))
    # those that meet disputed natives are withheld, whatever else they meet
    withheld = cut(across.join(disputed, ["page", "n"]).select("page", "o").distinct())
    met = across.join(withheld, ["page", "o"], "left_anti").join(trusted, ["page", "n"]).join(ocr.select("page", F.col("n").alias("o"), F.col("key").alias("own")), ["page", "o"])
    judged = cut(met.groupBy("page", "o").agg(F.count("*").alias("m"), F.bool_and(F.col("key") == F.col("own")).alias("same"), F.collect_list("n").alias("natives")))  # as many natives as one reading covers
    equal = (F.col("m") == 1) & F.col("same")
    verdict = F.when(equal, "DUPLICATE_OCR_READING").otherwise("NATIVE_OCR_TEXT_CONFLICT")
    left = ocr.join(withheld.unionByName(judged.select("page", "o")).withColumnRenamed("o", "n"), ["page", "n"], "left_anti")
    inner = pairs.filter("ta = 1 and tb = 1").select("page", "a", "b")
    for side in "ab":
        inner = inner.join(left.select("page", F.col("n").alias(side)), ["page", side], "left_semi")
    of_ocr = cut(_among(left, inner.select("page", "a", "b"), "OCR_TEXT_CONFLICT", "DUPLICATE_OCR_READING", "DUPLICATE_OCR_READING"))

    said = lambda df, source, out, doubt: df.select("page", F.lit(source).alias("source"), F.col("n").alias("id"), "reason", out.alias("out"), doubt.alias("doubt"))
    no, yes = F.lit(False), F.lit(True)
    reasons = said(of_native, "native", F.col("taken_back") | ~F.col("kept"), F.col("taken_back"))
    reasons = reasons.unionByName(said(judged.select("page", F.explode("natives").alias("n"), verdict.alias("reason")).distinct(), "native", no, no))
    reasons = reasons.unionByName(said(withheld.select("page", F.col("o").alias("n"), F.lit("NATIVE_CONFLICT_UNRESOLVED").alias("reason")), "ocr", yes, yes))
    reasons = reasons.unionByName(said(judged.select("page", F.col("o").alias("n"), verdict.alias("reason"), (~equal).alias("differs")), "ocr", yes, F.col("differs")))
    reasons = reasons.unionByName(said(of_ocr, "ocr", F.col("taken_back") | ~F.col("kept"), F.col("taken_back")))
    per = reasons.groupBy("page", "source", "id").agg(F.bool_or("out").alias("out"), F.bool_or("doubt").alias("doubt"), F.sort_array(F.collect_set("reason")).alias("reasons"))  # a few reasons there are

    unusable = (F.col("source") == "native") & ~F.col("valid") & F.col("boxed")
    df = all_.join(per, ["page", "source", "id"], "left")
    hidden = F.col("hidden") & (F.col("source") == "native")
    in_main = F.col("boxed") & ~unusable & ~hidden & ~F.coalesce("out", no)
    status = F.when(unusable | F.coalesce("doubt", no), "ambiguous").when(F.col("boxed"), "selected")
    listed = F.when(unusable, F.array(F.lit("NATIVE_TEXT_UNUSABLE"))).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))
    return df.select("page", "source", "id", in_main.alias("in_main"), status.alias("status"), listed.alias("reasons"))



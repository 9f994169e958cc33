"""Declarative extraction plans: table look-ups, patterns, rule sets and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import decimal_input, enum_value, first_number, found_unit, normalised
from docengine.operators.search import regex_values
from docengine.session import dealt

# Limits of a plan.
MAX_ANCHORS, MAX_PATTERN, MAX_STEPS, MAX_WINDOW = 16, 400, 6, 12


@dataclass(frozen=True)
class RegexPlan:
    """Anchors, a pattern with one group, and how many lines behind the anchor are searched."""

    code: str
    anchors: tuple[str, ...]
    pattern: str
    window: int = 0
    type: str = "number"
    units: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= len(self.anchors) <= MAX_ANCHORS:
            raise ValueError("a plan has 1 to 16 anchors")
        if len(self.pattern) > MAX_PATTERN or not 0 <= self.window <= MAX_WINDOW:
            raise ValueError("the pattern or the window is too long")
        if self.type not in ("number", "text", "enum"):
            raise ValueError(f"unknown type {self.type}")


def strict_number(x: Column, single: bool = False) -> Column:
    """The first separate number in canonical form; with ``single`` null unless it is the only one.

    Spaces between groups of three digits are taken out first; then a number is a word of digits, with a
    sign or decimals, between spaces, brackets, quotes or closing punctuation. So "m2" and "1.2.3" hold
    none. Texts that begin with a list marker ("3) ...") give null.
    """
    joined = F.regexp_replace(x, r"(?<=(?<!\d)\d{1,3})[ \u00a0\u202f](?=\d{3}(?!\d))", "")
    bare = F.transform(F.split(joined, r"[\s\u00a0\u202f]+"), lambda w: F.regexp_replace(w, "^[(\\[\"«]+|[)\\]\"»;:,.!?]+$", ""))
    numbers = F.filter(bare, lambda w: w.rlike(r"^[+\u2212-]?\d+(?:[.,]\d+)?$"))
    fine = (F.size(numbers) == 1) if single else (F.size(numbers) >= 1)
    return F.when(fine & ~x.rlike(r"^\s*\d+[.)](?:\s|$)"), decimal_input(F.regexp_replace(F.get(numbers, F.lit(0)), "\u2212", "-")))


def typed(x: Column, plan: RegexPlan) -> Column:
    """struct(value, unit) of a captured text by the plan's type; null value where it doesn't fit."""
    if plan.type == "number":
        value = first_number(x).cast("string")
    elif plan.type == "enum":
        value = enum_value(x, plan.allowed)
    else:
        value = F.when(F.trim(x) != "", F.trim(x))
    unit = found_unit(x, plan.units) if plan.units else F.lit(None).cast("string")
    return F.struct(value.alias("value"), unit.alias("unit"))


def run_regex(blocks: DataFrame, plan: RegexPlan) -> DataFrame:
    """(doc_id, code, value, unit) of each capture."""
    found = regex_values(blocks, plan.anchors, plan.pattern, plan.window)
    return found.withColumn("t", typed(F.col("value"), plan)).select("doc_id", F.lit(plan.code).alias("code"), "t.value", "t.unit").filter("value is not null")


def run_rules(documents: DataFrame, blocks: DataFrame, plans: Sequence[RegexPlan]) -> DataFrame:
    """(doc_id, code, outcome, value): every rule on every document; outcome by the number of distinct values."""
    found = None
    for plan in plans:
        one = run_regex(blocks, plan)
        found = one if found is None else found.unionByName(one)
    each = found.groupBy("doc_id", "code").agg(F.countDistinct("value").alias("n"), F.min("value").alias("one"))
    codes = F.explode(F.array(*[F.lit(p.code) for p in plans])).alias("code")
    every = documents.select("doc_id", codes).join(each, ["doc_id", "code"], "left")
    outcome = F.when(F.coalesce("n", F.lit(0)) == 0, "no_evidence").when(F.col("n") == 1, "extracted").otherwise("ambiguous")
    return every.select("doc_id", "code", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias("value"))


def run_on_pages(documents: DataFrame, blocks: DataFrame, pages: DataFrame, plans: Sequence[RegexPlan]) -> DataFrame:
    """run_rules on selected pages only: pages are chosen before anything is searched."""
    return run_rules(documents, blocks.join(pages.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi"), plans)


def missing_anchors(blocks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term): the terms that no block contains; one aggregate over the blocks."""
    text = normalised(F.col("raw_text"))
    hits = blocks.agg(*[F.coalesce(F.bool_or(text.contains(normalised(F.lit(t)))), F.lit(False)).alias(f"t{i}") for i, t in enumerate(terms)])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("hit")) for i, t in enumerate(terms)])).alias("p")
    return hits.select(pairs).filter(~F.col("p.hit")).select("p.term")


def table_lookup(cells: DataFrame, table: str, any_of: Sequence[str], row_term: str, min_score: int = 1, all_of: Sequence[str] = (), header: str | None = None, column: int | None = None) -> DataFrame:
    """(table, score, row, value): in tables that name enough of the terms, a number of the rows that name row_term.

    cells: table, row, col, text. A table must name all of all_of and min_score of any_of. A row names the
    term anywhere in its joined text. The number is the rightmost separate one of the row, or of the
    columns whose first row names ``header``, or of the given column.
    """
    names = [*any_of, *all_of, *([] if header is None else [header])]
    named = [F.coalesce(F.col("norm").contains(normalised(F.lit(x))), F.lit(False)).alias(f"f{i}") for i, x in enumerate(names)]
    flagged = cells.filter(F.col(table).isNotNull() & F.col("row").isNotNull()).select(table, "row", "col", "text", normalised(F.col("text")).alias("norm")).select(table, "row", "col", "text", *named)
    # dealt once by table; what follows is a row of a table, and what its table names in a window over its rows
    heads = F.collect_set(F.when((F.col("row") == 0) & F.col(f"f{len(names) - 1}"), F.col("col"))) if header is not None else F.array()
    found = [F.max(f"f{i}").alias(f"f{i}") for i in range(len(names))]
    rows = dealt(flagged, table).groupBy(table, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"), heads.alias("heads"), *found)  # bounded by one row of a table
    w = Window.partitionBy(table)
    has = [F.max(f"f{i}").over(w).cast("int") for i in range(len(any_of) + len(all_of))]
    score, every = sum(has[: len(any_of)], F.lit(0)), F.least(F.lit(1), F.lit(1), *has[len(any_of) :])
    rows = rows.select(table, "row", "cells", score.alias("score"), every.alias("all"), F.flatten(F.collect_list("heads").over(w)).alias("heads") if header is not None else "heads")
    rows = rows.filter((F.col("score") >= min_score) & (F.col("all") == 1)).filter(normalised(F.array_join("cells.text", " ")).contains(normalised(F.lit(row_term))))
    asked = rows.select(table, "score", "row", "heads", F.explode("cells").alias("c")).select(table, "score", "row", "heads", "c.*")
    if column is not None:
        asked = asked.filter(F.col("col") == column)
    if header is not None:
        asked = asked.filter(F.array_contains("heads", F.col("col")))
    right = Window.partitionBy(table, "row").orderBy(F.desc("col"))
    numbers = asked.withColumn("value", strict_number(F.col("text")).cast("double")).filter("value is not null").withColumn("rank", F.row_number().over(right)).filter("rank = 1")
    return numbers.select(table, "score", "row", "value")

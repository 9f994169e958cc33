"""Text normalisation, numbers, units and dates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings (after normalised()) and their canonical names.
UNITS = {
    "м²": "m2", "м2": "m2", "кв.м": "m2", "кв. м": "m2", "кв м": "m2", "m2": "m2", "m²": "m2",
    "м³": "m3", "м3": "m3", "куб.м": "m3", "куб. м": "m3", "m3": "m3", "m³": "m3",
    "м": "m", "п.м": "m", "пог.м": "m", "пог. м": "m", "m": "m", "км": "km",
    "шт": "pcs", "шт.": "pcs", "ед": "pcs", "ед.": "pcs", "кв": "kV",
}


def normalised(x: Column) -> Column:
    """Lower case, ё as е, runs of white space (no-break ones too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "ё", "е"), r"(?U)\s+", " "))


def item_key(x: Column) -> Column:
    """Lower case, ё as е, all but digits and Latin and Cyrillic letters as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "ё", "е"), "[^0-9a-zа-я]+", " "))


def line_text(x: Column) -> Column:
    """Runs of spaces, tabs and no-break spaces as one space and each line trimmed; line ends stay."""
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.trim(F.regexp_replace(line, "[ \t ]+", " "))), "\n")


def stage_code(x: Column) -> Column:
    """Stage of a mark: п -> PD, р or Latin p -> RD."""
    k = F.lower(F.trim(x))
    return F.when(k == "п", "PD").when(k.isin("р", "p"), "RD")


def calendar_date(x: Column) -> Column:
    """dd.mm.yyyy or ISO, null for anything else and for days that don't exist."""
    t = F.trim(x)
    return F.when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(t, "dd.MM.yyyy")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def first_number(x: Column) -> Column:
    """The first number: white space between digits groups thousands, comma or point before decimals."""
    raw = F.regexp_extract(x, "-?\\d[\\d \t\n\r  ]*(?:[.,]\\d+)?", 0)
    return F.regexp_replace(F.regexp_replace(raw, "[ \t\n\r  ]", ""), ",", ".").try_cast("double")


def decimal_input(x: Column) -> Column:
    """A decimal written in either locale as its canonical form; null where it is ambiguous."""
    t = F.regexp_replace(F.trim(x), "[  ]", " ")
    plain = t.rlike(r"^[+-]?(\d{1,3}( \d{3})+|\d+)([.,]\d+)?$")
    return F.when(plain, F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " ", ""), ",", "."), r"^\+", ""))


def unit_name(x: Column) -> Column:
    """The canonical unit; unknown spellings stay as normalised."""
    key = normalised(x)
    table = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    return F.when(key != "", F.coalesce(table[key], table[F.regexp_replace(key, " ", "")], key))


def found_unit(x: Column, accepted: Sequence[str]) -> Column:
    """The first accepted unit that the text names."""
    text = normalised(x)
    return F.coalesce(*[F.when(text.contains(normalised(F.lit(u))), unit_name(F.lit(u))) for u in accepted], F.lit(None).cast("string"))


def enum_value(x: Column, allowed: Sequence[str]) -> Column:
    """The first allowed value that the text equals or contains."""
    text = normalised(x)
    return F.coalesce(*[F.when(text.contains(normalised(F.lit(v))), F.lit(v)) for v in allowed], F.lit(None).cast("string"))


def effective_text(normal: Column, raw: Column) -> Column:
    """The trimmed normalised text, or the raw one where that is missing or empty."""
    return F.trim(F.coalesce(F.when(normal != "", normal), raw))


def contains_term(x: Column, term: Column) -> Column:
    """Containment regardless of case, ё and spacing; nothing is contained in an empty text."""
    text = normalised(x)
    return (text != "") & text.contains(normalised(term))


def excerpt(x: Column, term: str, around: int = 160) -> Column:
    """The text around the first occurrence of a term."""
    at = F.locate(term.lower(), F.lower(x))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(x, start, at - start + len(term) + around))


def heading_kind(x: Column) -> Column:
    """numbered, keyword, toc (dot leaders), capitals (2 to 8 words) or null."""
    t = F.trim(x)
    words = F.size(F.split(t, r"\s+"))
    return (
        F.when(t.rlike(r"\.{4,}\s*\d+$"), "toc")
        .when(t.rlike(r"^\d+(\.\d+)*\.?\s+\S"), "numbered")
        .when(F.lower(t).rlike(r"^(section|chapter|part|annex|раздел|глава|приложение)\b"), "keyword")
        .when((t == F.upper(t)) & (t != F.lower(t)) & words.between(2, 8), "capitals")
    )


def compact_path(x: Column) -> Column:
    """Positions in an XML path removed: a[3]/b[1] -> a[]/b[]."""
    return F.regexp_replace(x, r"\[\d+\]", "[]")


def rounded(x: Column, digits: int, mode: str) -> Column:
    """Decimal rounding: half_up, half_even or toward_zero."""
    if mode == "half_up":
        return F.round(x, digits)
    if mode == "half_even":
        return F.bround(x, digits)
    if mode != "toward_zero":
        raise ValueError(mode)
    scale = F.lit(10**digits).cast("decimal(20,0)")
    return F.signum(x).cast("int") * (F.floor(F.abs(x) * scale) / scale)


def locale_key(x: Column) -> Column:
    """The text for sorting and comparing as readers do: letters before case and accents, alphabets one after the other (root order of ICU)."""
    return F.collate(x, "UNICODE")


def locale_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a comes before, with or after b in that order; null if one is null."""
    x, y = locale_key(a), locale_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(a.isNotNull() & b.isNotNull(), 0)

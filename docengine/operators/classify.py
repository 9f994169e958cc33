"""Rule classification of documents: titles, their context, fields and list sections."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The beginning of a title (after composed()), whether the title ends there, its stage and kind.
TITLES = [
    ("проектная документация", True, "PD", None),
    ("рабочая документация", True, "RD", None),
    ("пояснительная записка", True, "PD", "Пояснительная записка"),
    ("схема планировочной организации земельного участка", True, "PD", "Схема планировочной организации земельного участка"),
    ("проект организации строительства", True, "PD", "Проект организации строительства"),
    ("проект организации работ по сносу", True, "PD", "Проект организации работ по сносу"),
    ("мероприятия по охране окружающей среды", True, "PD", "Мероприятия по охране окружающей среды"),
    ("мероприятия по обеспечению пожарной безопасности", True, "PD", "Мероприятия по обеспечению пожарной безопасности"),
    ("мероприятия по обеспечению доступа инвалидов", False, "PD", "Мероприятия по обеспечению доступа инвалидов к объекту"),
    ("смета на строительство", False, "PD", "Смета на строительство, реконструкцию, капитальный ремонт, снос"),
    ("конструктивные решения", True, "PD", "Конструктивные решения"),
    ("технологические решения", True, "PD", "Технологические решения"),
    ("акт разбивки осей", False, "ID", "Акт разбивки осей объекта на местности"),
    ("акт освидетельствования геодезической разбивочной основы", False, "ID", "Акт освидетельствования геодезической разбивочной основы"),
    ("акт освидетельствования строительных конструкций", False, "ID", "Акт освидетельствования строительных конструкций"),
    ("акт освидетельствования участка сетей", False, "ID", "Акт освидетельствования участка сетей инженерно-технического обеспечения"),
    ("акт испытания", False, "ID", "Акт испытания технических устройств и систем ИТО"),
    ("общий журнал работ", False, "ID", "Общий и специальные журналы работ"),
    ("исполнительная геодезическая схема", False, "ID", "Исполнительная геодезическая схема (чертеж)"),
    ("исполнительная схема участка сетей", False, "ID", "Исполнительная схема участка сетей инженерно-технического обеспечения"),
    ("ведомость основных комплектов", False, "RD", "Ведомость основных комплектов рабочих чертежей"),
    ("ведомость ссылочных", False, "RD", "Ведомость ссылочных и прилагаемых документов"),
    ("ведомость рабочих чертежей", False, "RD", "Ведомость рабочих чертежей"),
    ("спецификация оборудования", False, "RD", "Спецификация оборудования, изделий и материалов"),
]
# Titles that need a pattern.
TITLE_PATTERNS = [
    (r"^(?:акт\s+)?освидетельствования скрытых работ(?:\s*№.*)?[.\s]*$", "ID", "Акт освидетельствования скрытых работ"),
    (r"^исполнительная схема(?:[.\s]|$)", "ID", "Исполнительная схема"),
    (r"^реестр исполнительной документации(?:\s+от\s+\d|[.\s]*$)", "ID", "Реестр исполнительной документации"),
]
REFERENCE_WORDS = r"(?iu)работы выполнены|приложени[яе]|ссылочн|перечень|содержание|ведомость|наименование исполнительной документации"
DAY = r"(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2})"
# Labelled fields of a block.
FIELDS = {
    "number": r"(?iu)^(?:акт(?:\s+освидетельствования\s+скрытых\s+работ)?|АОСР)\s*№\s*([^\s,;]+)(?:\s|$)",
    "date": rf"(?iu)^(?:дата документа|дата составления)\s*[:：]\s*{DAY}$",
    "code": r"(?iu)^(?:шифр(?: документа)?|обозначение документа)\s*[:：]\s*(\S.{0,159})$",
    "revision_label": r"(?iu)^(?:редакция|ревизия|номер изменения)\s*[:：]\s*(\S.{0,79})$",
    "scope": r"(?iu)^(?:область работ|область применения)\s*[:：]\s*(\S.{0,299})$",
    "reference_code": r"(?iu)^шифр (?:проектной|рабочей) документации\s*[:：]\s*(\S.{0,159})$",
}
PERIOD = rf"(?iu)^период работ\s*[:：]\s*{DAY}\s*(?:—|–|по|до)\s*{DAY}$"
# Where a list begins, what its lines look like and where it ends.
LIST_START = r"(?iu)переч(?:е|ё)н[ья].{0,80}(скрытых|освидетельств)|освидетельствованию.{0,80}(скрытых|конструкц|сет)"
LIST_ITEM = r"^\s*(?:\d{1,2}[.)]\s*|[-–—]\s*)(\S.{3,200}?)\s*$"
LIST_STOP = r"(?iu)^\s*(?:\d{1,2}[.)]\s*)?[А-ЯЁ][А-ЯЁ\s]{4,}$|лист|раздел|общие данные|ведомость"
NETWORKS = r"сет[ьи]|трубопровод|кабельн|водоснабж|канализац|вентиляц|электро"
STRUCTURES = r"конструкц|элемент|каркас|балк|колонн|плита|фундамент|сва[иья]"


@F.pandas_udf(T.StringType())
def composed(x: pd.Series) -> pd.Series:
    """Unicode composition (NFC), which Spark has no function for."""
    return x.map(lambda s: unicodedata.normalize("NFC", s) if s is not None else None)


def clean_title(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(composed(x), r"(?U)\s+", " ")))


def title_class(clean: Column) -> Column:
    """struct(stage, kind) of a cleaned title, null for other texts and those over 260 characters."""
    found = F.lit(None).cast("struct<stage:string,kind:string>")
    entry = lambda stage, kind: F.struct(F.lit(stage).alias("stage"), F.lit(kind).cast("string").alias("kind"))
    for pattern, stage, kind in reversed(TITLE_PATTERNS):
        found = F.when(clean.rlike(pattern), entry(stage, kind)).otherwise(found)
    for start, ends, stage, kind in reversed(TITLES):
        fits = clean.startswith(start)
        if ends:
            fits = fits & F.substring(clean, len(start) + 1, 260).rlike(r"^[.\s]*$")
        found = F.when(fits, entry(stage, kind)).otherwise(found)
    return F.when(F.length(clean) <= 260, found)


def title_candidates(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_order, stage, kind): titles that don't stand near words of reference.

    The context is the block and the two before it; a window over one document's blocks.
    """
    w = Window.partitionBy("doc_id").orderBy("block_order").rowsBetween(-2, 0)
    near = F.array_join(F.collect_list("raw_text").over(w), " ")
    marked = blocks.withColumn("clean", clean_title(F.col("raw_text"))).withColumn("near", near).withColumn("t", title_class(F.col("clean")))
    own = F.col("t.kind").startswith("Ведомость") | F.col("t.kind").isNull()
    return marked.filter("t is not null").filter(~F.col("near").rlike(REFERENCE_WORDS) | F.coalesce(own, F.lit(False))).select("doc_id", "block_order", "t.stage", "t.kind")


def classified(candidates: DataFrame) -> DataFrame:
    """(doc_id, stage, kind, review): a single stage and kind decide, others call for a review."""
    g = candidates.groupBy("doc_id").agg(F.countDistinct("stage").alias("n"), F.countDistinct("kind").alias("k"), F.min("stage").alias("s"), F.min("kind").alias("one"))
    return g.select("doc_id", F.when(F.col("n") == 1, F.col("s")).alias("stage"), F.when((F.col("n") == 1) & (F.col("k") == 1), F.col("one")).alias("kind"), ((F.col("n") > 1) | (F.col("k") != 1)).alias("review"))


def fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_order, field, value) of labelled fields, one pass over the blocks."""
    t = F.trim("raw_text")
    pieces = [F.struct(F.lit(name).alias("field"), F.regexp_extract(t, pattern, 1).alias("value")) for name, pattern in FIELDS.items()]
    pieces += [F.struct(F.lit(name).alias("field"), F.regexp_extract(t, PERIOD, i).alias("value")) for i, name in ((1, "works_from"), (2, "works_to"))]
    return blocks.select("doc_id", "block_order", F.explode(F.array(*pieces)).alias("f")).select("doc_id", "block_order", "f.field", "f.value").filter("value <> ''")


def list_items(blocks: DataFrame, reach: int = 60) -> DataFrame:
    """(doc_id, block_order, title, list_kind): the items of lists behind their opening lines.

    An item belongs to the last opening line before it, at most ``reach`` lines away, if no
    closing line lies between; of equal titles the first stays. Windows over a document's lines.
    """
    w = Window.partitionBy("doc_id").orderBy("block_order")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("raw_text")
    marked = blocks.withColumn("opens", F.when(line.rlike(LIST_START), F.col("block_order"))).withColumn("closes", F.when(line.rlike(LIST_STOP) & ~line.rlike(r"^\s*\d{1,2}[.)]"), F.col("block_order")))
    placed = marked.withColumn("start", F.last("opens", ignorenulls=True).over(before)).withColumn("stop", F.last("closes", ignorenulls=True).over(w))
    inside = placed.filter((F.col("block_order") - F.col("start") < reach) & (F.coalesce("stop", F.lit(-1)) <= F.col("start")))
    found = inside.withColumn("title", F.trim(F.regexp_extract("raw_text", LIST_ITEM, 1))).filter("title <> ''")
    low = F.lower("title")
    kind = F.when(low.rlike(NETWORKS), "network_sections").when(low.rlike(STRUCTURES), "structures").otherwise("hidden_works")
    first = found.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", low).orderBy("block_order"))).filter("_rank = 1")
    return first.select("doc_id", "block_order", "title", kind.alias("list_kind"))

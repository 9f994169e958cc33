"""XML leaf items, HTML tables and file signatures; one row of a source gives many."""

from __future__ import annotations

import hashlib
import io
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES = 128, 200_000
ITEMS = "key long, item int, path string, value string, error string"
CELLS = "key long, table_no int, row int, col int, row_span int, col_span int, text string, valid boolean"


def xml_items(data: bytes | str | None) -> Iterator[tuple[str, str]]:
    """(path, text) of attributes and text pieces in document order, with positions among equal tags.

    Raises ValueError for entity declarations, broken XML and too deep or too many nodes.
    """
    raw = data.encode() if isinstance(data, str) else data or b""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("declaration")
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        raise ValueError("syntax") from e
    nodes = 0
    stack: list[tuple[ET.Element, str, int, bool]] = [(root, f"/{root.tag}[1]", 1, True)]
    while stack:
        node, path, depth, enter = stack.pop()
        if not enter:  # the text behind the element belongs to its parent
            yield f"{path}/tail()", node.tail or ""
            continue
        nodes += 1
        if depth > MAX_DEPTH:
            raise ValueError("depth")
        if nodes > MAX_NODES:
            raise ValueError("nodes")
        for name in sorted(node.attrib):
            yield f"{path}/@{name}", node.attrib[name]
        if len(node) == 0 or (node.text or "").strip():
            yield f"{path}/text()[1]", node.text or ""
        seen: Counter = Counter()
        below = []
        for child in node:
            seen[child.tag] += 1
            where = f"{path}/{child.tag}[{seen[child.tag]}]"
            below.append((child, where, depth + 1, True))
            if (child.tail or "").strip():
                below.append((child, where, depth, False))
        stack += reversed(below)


def read_xml(files: DataFrame, key: str, data: str) -> DataFrame:
    """The leaf items of each file; a rejected one gives a row with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, x in zip(batch.k, batch.x, strict=True):
                try:
                    out += [(k, i, p, v, None) for i, (p, v) in enumerate(list(xml_items(x)))]
                except ValueError as e:
                    out.append((k, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=["key", "item", "path", "value", "error"])
            yield frame.assign(item=frame["item"].astype("Int32"))

    return files.select(F.col(key).cast("long").alias("k"), F.col(data).alias("x")).mapInPandas(run, ITEMS)


class _Tables(HTMLParser):
    """Cells of all tables, nested ones too, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[dict]]] = []
        self.open: list[list] = []  # [rows, cell or None]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            rows: list[list[dict]] = []
            self.tables.append(rows)
            self.open.append([rows, None])
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
            self.open[-1][1] = None
        elif self.open and tag in ("td", "th"):
            rows = self.open[-1][0]
            if not rows:
                rows.append([])
            span = {n: max(1, int(v)) if (v or "").isdigit() else 1 for n, v in attrs if n in ("rowspan", "colspan")}
            self.open[-1][1] = {"rows": span.get("rowspan", 1), "cols": span.get("colspan", 1), "text": []}
            rows[-1].append(self.open[-1][1])

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th"):
            self.open[-1][1] = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1] is not None:
            self.open[-1][1]["text"].append(data)


def table_cells(html: str | None) -> Iterator[tuple[int, int, int, int, int, str, bool]]:
    """(table, row, column, row span, column span, text, valid) of each cell; a table with overlapping cells or ragged rows isn't valid."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for number, rows in enumerate(parser.tables):
        taken: set[tuple[int, int]] = set()
        cells, clash = [], False
        for r, row in enumerate(rows):
            col = 0
            for cell in row:
                while (r, col) in taken:
                    col += 1
                spots = {(r + i, col + j) for i in range(cell["rows"]) for j in range(cell["cols"])}
                clash |= bool(spots & taken)
                taken |= spots
                cells.append((r, col, cell["rows"], cell["cols"], " ".join("".join(cell["text"]).split())))
                col += cell["cols"]
        width = Counter(r for r, _ in taken)
        valid = not clash and len(set(width.values())) <= 1 and len(width) == len(rows)
        for r, c, i, j, text in cells:
            yield number, r, c, i, j, text, valid


def read_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The table cells of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *cell) for k, x in zip(batch.k, batch.x, strict=True) for cell in table_cells(x)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("x")).mapInPandas(run, CELLS)


def inspected(content: bytes | None) -> tuple[str | None, str | None]:
    """(format, error) of a file by its bytes: PDF, DOCX or XML; active content and zip bombs are errors."""
    data = content or b""
    if data.startswith(b"%PDF-"):
        active = any(x in data for x in (b"/JavaScript", b"/Launch", b"/EmbeddedFile"))
        return "PDF", "active_content" if active else None
    if data.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = z.infolist()
        except zipfile.BadZipFile:
            return None, "broken_archive"
        names = {i.filename for i in infos}
        if sum(i.file_size for i in infos) > 100 * max(1, sum(i.compress_size for i in infos)):
            return None, "zip_bomb"
        if "word/document.xml" not in names:
            return None, "unknown_format"
        return "DOCX", "active_content" if any(n.endswith("vbaProject.bin") for n in names) else None
    if data.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<"):
        try:
            for _ in xml_items(data):
                pass
        except ValueError as e:
            return "XML", str(e)
        return "XML", None
    return None, "unknown_format"


def inspect_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds format and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [inspected(bytes(x) if x is not None else None) for x in batch[content]]
            yield batch.assign(format=[f for f, _ in found], error=[e for _, e in found])

    fields = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInPandas(run, f"{fields}, format string, error string")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, result): ok, missing, size or hash for each manifest row (path, size, sha256) against files (path, content)."""
    held = files.select("path", F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_hash"))
    both = manifest.join(held, "path", "left")
    result = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_hash") != F.col("sha256"), "hash").otherwise("ok")
    return both.select("path", result.alias("result"))


def decoded_package(lines: DataFrame) -> DataFrame:
    """Files of JSON package rows (name, data in base64): content, size and sha256; undecodable data has null content."""
    content = F.try_to_binary(F.col("data"), F.lit("base64"))
    return lines.select("name", content.alias("content")).select("*", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

"""Cells of an ``.xlsx`` sheet, read inside the task that holds the workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd

ROW_SCHEMA = "texts array<string>, kinds array<string>"
KINDS = ("text", "whole", "real", "date", "truth")
BATCH = 10_000
# The built-in number formats that mean a date or a time.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind, freed as soon as they are used."""
    if name not in book.namelist():
        return
    with book.open(name) as stream:
        for _, element in ElementTree.iterparse(stream):
            if _local(element.tag) == tag:
                yield element
                element.clear()


def _text(element: ElementTree.Element) -> str:
    """Text of an element without its phonetic hints."""
    return "".join(
        t.text or "" for child in element if _local(child.tag) in ("t", "r")
        for t in ([child] if _local(child.tag) == "t" else child) if _local(t.tag) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    custom = {
        int(e.get("numFmtId")) for e in _elements(book, "xl/styles.xml", "numFmt")
        if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")), re.I)
    }
    dates = DATE_FORMATS | custom
    for xfs in _elements(book, "xl/styles.xml", "cellXfs"):
        return {i for i, xf in enumerate(xfs) if int(xf.get("numFmtId", 0)) in dates}
    return set()


def _sheet_file(book: zipfile.ZipFile, sheet: str) -> tuple[str, datetime]:
    epoch = datetime(1899, 12, 30)
    for e in _elements(book, "xl/workbook.xml", "workbookPr"):
        if e.get("date1904") in ("1", "true"):
            epoch = datetime(1904, 1, 1)
    for e in _elements(book, "xl/workbook.xml", "sheet"):
        if e.get("name") == sheet:
            link = next(v for k, v in e.attrib.items() if _local(k) == "id")
            for rel in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
                if rel.get("Id") == link:
                    target = rel.get("Target")
                    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", epoch
    raise ValueError(f"Worksheet named '{sheet}' not found")


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[dict[int, tuple[str, str]]]:
    """Rows as ``{column: (text, kind)}``; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name, epoch = _sheet_file(book, sheet)
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        for row in _elements(book, name, "row"):
            cells, index = {}, -1
            for c in row:
                index = _column_index(c.get("r")) if c.get("r") else index + 1
                kind, value = c.get("t", "n"), None
                for part in c:
                    if _local(part.tag) == "v":
                        value = part.text
                    elif _local(part.tag) == "is":
                        value = _text(part)
                if value is None or kind == "e":
                    continue
                if kind == "s":
                    cells[index] = (shared[int(value)], "text")
                elif kind in ("str", "inlineStr"):
                    cells[index] = (value, "text")
                elif kind == "b":
                    cells[index] = ("true" if value == "1" else "false", "truth")
                elif kind == "d":
                    cells[index] = (value, "date")
                elif int(c.get("s", 0)) in dates:
                    moment = epoch + timedelta(milliseconds=round(float(value) * 86_400_000))
                    cells[index] = (moment.isoformat(), "date")
                elif float(value).is_integer():
                    cells[index] = (str(int(float(value))), "whole")
                else:
                    cells[index] = (value, "real")
            yield cells


def headers(sheet: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Header of each workbook."""
    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                first = next(sheet_rows(content, sheet), {})
                names = [first.get(i, (f"Unnamed: {i}", ""))[0] for i in range(max(first, default=-1) + 1)]
                yield pd.DataFrame({"header": [names]})
    return read


def rows(sheet: str, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows below the header, a bounded number of them at a time."""
    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                texts, kinds = [], []
                body = sheet_rows(content, sheet)
                next(body, None)
                for cells in body:
                    texts.append([cells.get(i, (None, None))[0] for i in range(width)])
                    kinds.append([cells.get(i, (None, None))[1] for i in range(width)])
                    if len(texts) == BATCH:
                        yield pd.DataFrame({"texts": texts, "kinds": kinds})
                        texts, kinds = [], []
                yield pd.DataFrame({"texts": texts, "kinds": kinds})
    return read

"""Markdown of parsed pages: HTML tables as pipe tables, and no page numbers, security print, empty labels or picture placeholders."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pictures without text, labels that state nothing alone, and the widest cell.
PICTURES = ("logo", "seal", "signature", "photograph", "photo", "image", "icon", "stamp", "qr")
LABELS = ("date", "place", "udid", "udin")
WIDEST = 12
_PICTURE = re.compile(rf"!\[(?:{'|'.join(PICTURES)})[^\]]*\]\([^)]*\)|(?:logo|code)\s*:\s*(?:qr code|ca india).*", re.I)
_LABEL = re.compile(rf"(?:\*\*)?(?:{'|'.join(LABELS)})\s*:\s*(?:\*\*)?", re.I)
_TABLE = re.compile(r"<table\b[^>]*>.*?</table>", re.I | re.S)
_PAGE_MARK = re.compile(r"<!--\s*(?:page|p|sheet)\s*[0-9]+[^>]*?-->", re.I)
_PAGE_NUMBER = re.compile(r"\s*(?:page\s*)?[0-9]{1,3}\s*", re.I)
_NUMBER = re.compile(r"[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?")
_SPLIT_PAN = re.compile(r"\b([A-Za-z]{5}[0-9]{3,4})\s+([0-9A-Za-z]{1,2})(?![0-9A-Za-z])")


class _Rows(HTMLParser):
    """rows: the table's rows, each a list of (text, is a header cell)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, bool]]] = []
        self.cell: list[str] | None = None
        self.loose: list[str] = []
        self.wide, self.head = 1, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = dict(attrs).get("colspan") or "1"
            self.cell, self.head, self.wide = [], tag == "th", max(1, min(WIDEST, int(span))) if span.isdigit() else 1
        elif self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).replace("|", "/").split())
            self.rows = self.rows or [[]]
            self.rows[-1] += [(text, self.head)] + [("", self.head)] * (self.wide - 1)
            self.cell = None
        elif self.cell is not None:
            self.cell.append(" ")

    def handle_data(self, data):
        (self.loose if self.cell is None else self.cell).append(data)


def pipe_table(html: str) -> str:
    """The first row with header cells, else the first, heads the table and fixes its width: short rows are filled, what is over joins the last cell."""
    reader = _Rows()
    reader.feed(html)
    rows = [r for r in reader.rows if r]
    if not rows:
        return " ".join("".join(reader.loose).split())
    head = next((i for i, r in enumerate(rows) if any(h for _, h in r)), 0)
    width = len(rows[head])

    def line(row: list[tuple[str, bool]]) -> str:
        cells = [t for t, _ in row] + [""] * (width - len(row))
        cells[width - 1 :] = [" ".join(t for t in cells[width - 1 :] if t)]
        return "| " + " | ".join(cells) + " |"

    return "\n".join([line(rows[head]), "|" + "---|" * width, *(line(r) for i, r in enumerate(rows) if i != head)])


def is_security_print(token: str) -> bool:
    """A glue of digits and signs, such as a misread code; numbers, and whatever has two letters, are none."""
    if len(token) < 8 or _NUMBER.fullmatch(token):
        return False
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    if digits < 8 or letters > 1:
        return False
    return len(token) - digits - letters >= 3 or len(token) >= 16 and digits >= 14


def _one_pan(m: re.Match) -> str:
    whole = (m[1] + m[2]).upper()
    return whole if re.fullmatch("[A-Z]{5}[0-9]{4}[A-Z]", whole) else m[0]


def _says_nothing(cell: str) -> bool:
    bare = cell.strip().strip("*").strip()
    return bool(_PICTURE.fullmatch(cell.strip()) or _PICTURE.fullmatch(bare) or _LABEL.fullmatch(cell.strip()))


def _line(line: str) -> str | None:
    """A line as it stays; None if it goes."""
    if "|" in line:
        cells = [" " if c.strip() and _says_nothing(c) else _SPLIT_PAN.sub(_one_pan, c) for c in line.split("|")]
        return "|".join(cells) if any(c.strip() for c in cells) or not line.strip("| ") else ""
    if _PAGE_NUMBER.fullmatch(line):
        return None if line.strip() else ""
    kept = re.sub(r"\S+", lambda m: "" if is_security_print(m[0]) else m[0], line)
    kept = re.sub(r"[ \t]{2,}", " ", kept).rstrip() if kept != line else line
    return None if kept.strip() and _says_nothing(kept) else kept


def clean(markdown: str | None) -> str:
    """Empty for null; text that is blank stays."""
    if not (markdown or "").strip():
        return markdown or ""
    text = _PAGE_MARK.sub("", _TABLE.sub(lambda m: pipe_table(m[0]), markdown))
    lines = [x for x in map(_line, text.split("\n")) if x is not None]
    return re.sub(r"(?:[ \t]*\n){3,}", "\n\n", "\n".join(lines)).strip() + "\n"


def cleaned(c: Column) -> Column:
    """clean() in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return run(c)

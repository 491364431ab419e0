"""Delimited text: encoding and delimiter from a prefix, then one row for each field."""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections import Counter
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

PREFIX = 8192
RECORDS = 20
#: In the order in which ties are broken.
DELIMITERS = (",", ";", "\t", "|")


def encoding_of(prefix: bytes) -> str:
    """By byte order mark, else UTF-8 where the bytes are (a character cut by the prefix's end is none the less), else windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if prefix.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(prefix)
    except UnicodeDecodeError:
        return "windows-1252"
    return "utf-8"


def field_counts(text: str, delimiter: str, most: int = RECORDS) -> list[int]:
    """Fields of each record; quotes hide delimiters and line ends. A record that the prefix may have cut counts only if it is alone."""
    counts, fields, quoted, empty = [], 1, False, True
    for c in text:
        if c == '"':
            quoted, empty = not quoted, False
        elif quoted:
            continue
        elif c == delimiter:
            fields, empty = fields + 1, False
        elif c == "\n":
            if not empty:
                counts.append(fields)
                if len(counts) == most:
                    return counts
            fields, empty = 1, True
        elif c != "\r":
            empty = False
    return counts if counts or empty else [fields]


def delimiter_of(text: str) -> str:
    """The delimiter on whose field count most records agree; then more fields, then more records, then the earlier in DELIMITERS."""

    def rank(d: str) -> tuple[int, int, int]:
        counts = [n for n in field_counts(text, d) if n > 1]
        if not counts:
            return 0, 0, 0
        fields, agree = max(Counter(counts).items(), key=lambda x: (x[1], x[0]))
        return agree, fields, len(counts)

    return max(DELIMITERS, key=rank)


def sniff(prefix: bytes, encoding: str | None = None, delimiter: str | None = None) -> tuple[str, str]:
    """(encoding, delimiter); what is given is taken."""
    encoding = encoding or encoding_of(prefix)
    return encoding, delimiter or delimiter_of(prefix.decode(encoding, "replace").lstrip("﻿"))


def fields(text: str, delimiter: str):
    """(row, column, text) of every field, from 1; quotes hide delimiters and line ends, empty lines count but hold nothing."""
    csv.field_size_limit(sys.maxsize)
    for r, record in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        for c, value in enumerate(record, 1):
            yield r, c, value


def read_cells(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """path, row_num, col_num, text of every field of the files at path; each file's own prefix decides its dialect.

    A file is read in one piece, once, as quoted line ends need it.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                coding, sep = sniff(content[:PREFIX], encoding, delimiter)
                cells = fields(content.decode(coding, "replace").lstrip("\ufeff"), sep)
                while part := list(islice(cells, 50_000)):
                    r, c, t = zip(*part)
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "row_num": pa.array(r, pa.int32()), "col_num": pa.array(c, pa.int32()), "text": pa.array(t, pa.string())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row_num int, col_num int, text string")

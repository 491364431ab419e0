"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor.

A template is a licence's notice. Terms are lower-case words without punctuation at their ends. A term's weight is its count
times ln((1 + documents) / (1 + documents that hold it)), with document counts over the whole corpus, of outside words too.
Windows of one to three lines are compared with every template, and in licence files the whole text too; windows of as many
words as a template has, over any lines, that begin or end with one of its terms are compared with it. The best window of at
least `threshold` is the file's own licence; ties go to the earlier template. Texts are skipped only where no window can reach
the threshold: for each template, the terms without which the rest of it stays below the threshold are its keys, and a
window needs one of some template's keys. Document counts of outside words are joined only to texts that have a window of at
least the threshold if those words weigh nothing; the score of other texts is 0.

A licence file (by its name) also licenses its directory; of several, the best score counts, then the least path. A file
without a licence of its own takes that of the nearest directory above it that has one: the distinct directories are
joined with their ancestors, never files with files. Null texts are empty; rows of a null path have no directory and keep
their own licence. Repeated rows are scanned each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.shared import as_bytes, cut, ready, set_aside

THRESHOLD = 0.7
#: Lines of a window at most.
LINES = 3
#: Terms that a task counts before it sends them on.
HELD_TERMS = 200_000
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$"
#: Notices by SPDX id, in order of preference among equals.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."),
    "Proprietary": ("Copyright. All rights reserved.", "This file is proprietary and confidential; unauthorized copying is prohibited."),
}
_TERM = re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Templates as unit TF-IDF vectors, given document frequencies of their terms."""

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[str, int], docs: int, threshold: float):
        self.threshold = threshold
        self.other = math.log((1 + docs) / 2) if docs > 1 else 1.0
        self.idf = {t: max(1e-3, math.log((1 + docs) / (1 + df.get(t, 0))) if docs > 1 else 1.0) for x in templates.values() for n in x for t in terms(n)}
        self.names, self.vectors, keys = [], [], set()
        for name, notices in templates.items():
            for notice in notices:
                v = {t: c * self.idf[t] for t, c in Counter(terms(notice)).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                self.names.append(name)
                self.vectors.append({t: x / norm for t, x in v.items()})
                # The heaviest terms, until the others together stay below the threshold.
                left = 1.0
                for t, x in sorted(self.vectors[-1].items(), key=lambda i: (-i[1], i[0])):
                    if left < threshold * threshold - 1e-9:
                        break
                    keys.add(t)
                    left -= x * x
        # Longest first, so that a key is tried before its beginnings; a key that is a term has no letter or digit beside it.
        self.keys = re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k))) + r")(?![^\W_])")
        self.sizes = [len(terms(n)) for x in templates.values() for n in x]
        self.docs = docs

    def score(self, words: list[str], df: dict[str, int] | None = None, only: tuple[int, ...] | None = None, light: bool = False) -> tuple[float, int]:
        """The best cosine over templates (or those of only), and which. df: document counts of outside words; a word without
        one counts as held by one document. light: outside words weigh nothing, which no score exceeds."""
        v = {}
        for t, c in Counter(words).items():
            if t in self.idf:
                v[t] = c * self.idf[t]
            elif not light:
                v[t] = c * (max(1e-3, math.log((1 + self.docs) / (1 + df[t]))) if df and t in df and self.docs > 1 else self.other)
        norm = math.sqrt(sum(x * x for x in v.values()))
        best, which = 0.0, -1
        if norm:
            for k in range(len(self.vectors)) if only is None else only:
                s = sum(x * v[t] for t, x in self.vectors[k].items() if t in v) / norm
                if s > best + 1e-12:
                    best, which = s, k
        return best, which

    def windows(self, text: str, whole: bool):
        """The windows that can reach the threshold, with the templates to compare (None: all)."""
        lower = text.lower()
        at, line, last = [], 0, 0
        for m in self.keys.finditer(lower):
            line += lower.count("\n", last, m.start())
            last = m.start()
            if not at or at[-1] != line:
                at.append(line)
        if not at:
            return
        lines = [terms(x) for x in lower.split("\n")]
        words = [t for x in lines for t in x]
        if whole:
            yield words, None
        for start, end in sorted({(i - k, i - k + n) for i in at for n in range(1, LINES + 1) for k in range(n) if i - k >= 0 and i - k + n <= len(lines)}):
            yield [t for x in lines[start:end] for t in x], None
        have, least = self.idf.keys() & set(words), self.threshold * self.threshold - 1e-9
        for k, (vector, size) in enumerate(zip(self.vectors, self.sizes)):
            if sum(x * x for t, x in vector.items() if t in have) < least:
                continue
            top = max(0, len(words) - size)
            for start in sorted({min(max(0, s), top) for i, t in enumerate(words) if t in vector for s in (i, i - size + 1)}):
                part = words[start : start + size]
                if sum(vector[t] ** 2 for t in vector.keys() & set(part)) >= least:
                    yield part, (k,)

    def outside(self, text: str, whole: bool) -> list[str] | None:
        """The outside words of windows that reach the threshold if those weigh nothing; None where no window does."""
        found = [set(w) for w, only in self.windows(text, whole) if self.score(w, only=only, light=True)[0] >= self.threshold - 1e-9]
        return sorted(set().union(*found) - self.idf.keys()) if found else None

    def scan(self, text: str, whole: bool, df: dict[str, int] | None = None) -> tuple[str | None, float]:
        """Own licence and score of a text."""
        best, which = 0.0, -1
        for words, only in self.windows(text, whole):
            s, k = self.score(words, df, only)
            if s > best + 1e-12 or (s > best - 1e-12 and 0 <= k < which):
                best, which = s, k
        return (self.names[which], best) if best >= self.threshold else (None, best)


def term_counts(files: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term, and under "" documents; tasks count before the shuffle."""

    def run(batches):
        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([*count, ""], pa.string()), pa.array([*count.values(), docs], pa.int64())], names=["term", "n"])

        count, docs = Counter(), 0
        for b in batches:
            for text in as_bytes(b.column("text")):
                docs += 1
                count.update(set(terms(text.decode())))
                if len(count) > HELD_TERMS:
                    yield rows()
                    count, docs = Counter(), 0
        yield rows()

    return files.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def document_frequencies(files: DataFrame, vocabulary: set[str], counts: DataFrame | None = None) -> tuple[dict[str, int], int]:
    """Documents that hold each term of the vocabulary, and documents, over all files."""
    counts = term_counts(files) if counts is None else counts
    got = {r.term: r.n for r in counts.where(F.col("term").isin([*vocabulary, ""])).collect()}
    return {t: int(got.get(t, 0)) for t in sorted(vocabulary)}, int(got.get("", 0))


def own_licenses(files: DataFrame, keep: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files' columns in keep, is_license_file, own_license and own_score of every row."""
    spark = ready(files.sparkSession)
    vocabulary = {t for x in templates.values() for n in x for t in terms(n)}
    counts = cut(term_counts(files))
    matcher = spark.sparkContext.broadcast(Matcher(templates, *document_frequencies(files, vocabulary, counts), threshold))
    src = files.select(*dict.fromkeys([*keep, "path", "text"])).withColumn("is_license_file", F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)))
    names = [*keep, "is_license_file"]

    def near(batches):
        import pyarrow as pa

        m = matcher.value
        for b in batches:
            texts = [x.decode() for x in as_bytes(b.column("text"))]
            need = [m.outside(x, w) for x, w in zip(texts, b.column("is_license_file").to_pylist())]
            own = [None if n is None else x for x, n in zip(texts, need)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(own, pa.string()), pa.array(need, pa.list_(pa.string()))], names=[*names, "_text", "_need"])

    def exact(batches):
        import pyarrow as pa

        m = matcher.value
        for b in batches:
            rows = zip(b.column("_text").to_pylist(), b.column("is_license_file").to_pylist(), b.column("_df").to_pylist())
            found = [m.scan(x, w, {i["term"]: i["n"] for i in df or ()}) for x, w, df in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "own_license", "own_score"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    shape = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    rows = cut(src.mapInArrow(near, shape + ", _text string, _need array<string>").withColumn("_row", F.monotonically_increasing_id()))
    some = rows.where("_need is not null")
    known = some.select("_row", F.explode("_need").alias("term")).join(counts, "term").groupBy("_row").agg(F.collect_list(F.struct("term", "n")).alias("_df"))
    matched = some.drop("_need").join(known, "_row", "left").mapInArrow(exact, shape + ", own_license string, own_score double")
    rest = rows.where("_need is null").select(*names, F.lit(None).cast("string").alias("own_license"), F.lit(0.0).alias("own_score"))
    return matched.unionByName(rest)


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned (path, is_license_file, own_license, own_score, more) with license and inherited_from (a directory, "" the top)."""
    cols = scanned.columns
    rows = scanned.withColumn("dir", F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/+$", ""))
    rows = cut(rows.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir"))))
    licensed = rows.where("is_license_file and own_license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license"))["own_license"].alias("dir_license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("ancestor"))
    nearest = dirs.join(licensed.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "dir_license")).alias("near"))
    nearest = cut(nearest.select("dir", "near.ancestor", "near.dir_license"))
    joined = rows.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(*cols, F.coalesce("own_license", "dir_license").alias("license"), F.when(~own, F.col("ancestor")).alias("inherited_from"))


def scan(files: DataFrame, keep: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files' columns in keep and path, with is_license_file, own_license, own_score, license and inherited_from of every row.

    A column of files that has the name of one of these gives way to it.
    """
    rows, aside = set_aside(files.select(*dict.fromkeys([*keep, "path", "text"])), ["path", "text"])
    held = [k for k, n in aside.items() if n in keep]
    if "text" in keep:
        rows, held = rows.withColumn("__aside_text", F.col("text")), [*held, "__aside_text"]
    out = inherit(own_licenses(rows, [*held, "path"], templates, threshold))
    own = ["path", "is_license_file", "own_license", "own_score", "license", "inherited_from"]
    names = {k: aside.get(k, "text") for k in held}
    return out.select(*(F.col(k).alias(n) for k, n in names.items() if n.lower() not in own), *own)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source/language/block of 500 ids; one in 20 stands for its block's licence file."""
    folder = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 500).cast("string"))
    name = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 20 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", folder, name)).alias("path"), "text")

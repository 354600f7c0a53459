"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Each text is cut into sentences, lines and paragraphs; those with a term without which no template
can be near enough are compared with the templates by the cosine of TF-IDF vectors, and the best is
the file's own license; a text that is a template as a whole has that template's. A text that is a template as a whole, or has a license and the name of a license file,
stands for its directory; files without a license of their own take that of the nearest ancestor directory which
has one. Document frequencies of the templates' terms are counted over all texts.

Directories, not files, are expanded into their ancestors, so a directory with very many files
costs one row there; the join of files to directories is salted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import cut, table

_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


# Headers and opening passages of common licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("program", "General", "2")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("library", "Lesser General", "2.1")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _gnu("library", "Lesser General", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("program", "Affero General", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        _REDISTRIBUTION,
        _BSD_3,
        " ".join((_REDISTRIBUTION, _BSD_1, _BSD_2, _BSD_3, _BSD_END)),
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", " ".join((_REDISTRIBUTION, _BSD_1, _BSD_2, _BSD_END))],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain under the Unlicense."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Proprietary": ["Copyright. All rights reserved. Proprietary and confidential."],
}
SPDX = re.compile(rb"spdx-license-identifier:\s*([\w.+-]+)", re.I)
_IDS = {name.lower().encode(): name for name in TEMPLATES}
#: Least cosine of a passage, and of a whole text for it to be a license file.
PASSAGE, FILE = 0.75, 0.9
#: Names of license files, which need only hold a license.
NAMES = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"
SALTS = 16
_ALNUM = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n")
_PARAGRAPH = re.compile(rb"\n[ \t]*\n")


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_ALNUM).split()


VOCABULARY = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms_of(x.encode()))


def document_frequencies(files: DataFrame) -> tuple[int, dict[bytes, int]]:
    """How many texts there are, and how many have each term of the templates (a bounded list)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch["text"]:
                n += 1
                sums.update(VOCABULARY.intersection(terms_of((text or "").encode("utf-8", "surrogatepass"))))
        yield pd.DataFrame({"term": [*sums, b" "], "n": [*sums.values(), n]})

    rows = files.select("text").mapInPandas(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["term"]): r["n"] for r in rows}
    return found.pop(b" ", 0), found


class Matcher:
    """TF-IDF vectors of the templates; cosine of a passage to the nearest."""

    def __init__(self, texts: int, frequencies: dict[bytes, int]):
        self.unknown = log(texts + 1) + 1
        self.idf = {t: log((texts + 1) / (frequencies.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.templates = []
        for name, passages in TEMPLATES.items():
            for passage in passages:
                vector = {t: k * self.idf[t] for t, k in Counter(terms_of(passage.encode())).items()}
                norm = sqrt(sum(w * w for w in vector.values()))
                self.templates.append((name, {t: w / norm for t, w in vector.items()}))
        # a passage that has none of some terms of a template is no nearer to it than the length of the rest; the
        # rarest terms are taken, since those keep the most texts out
        needed: set[bytes] = set()
        for _, template in self.templates:
            rest = 1.0
            for term in sorted(template, key=lambda t: (frequencies.get(t, 0), -template[t], t)):
                if rest < PASSAGE * PASSAGE - 1e-9:
                    break
                needed.add(term)
                rest -= template[term] ** 2
        self.needed = frozenset(needed)

    def nearest(self, passage: bytes) -> tuple[float, str | None]:
        counts = Counter(terms_of(passage))
        vector = {t: k * self.idf.get(t, self.unknown) for t, k in counts.items()}
        norm = sqrt(sum(w * w for w in vector.values()))
        if not norm:
            return 0.0, None
        best, of = 0.0, None
        for name, template in self.templates:
            score = sum(w * vector[t] for t, w in template.items() if t in vector) / norm
            if score > best + 1e-12:
                best, of = score, name
        return best, of

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """The text's own license, its cosine, and whether the text as a whole is a license file."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        named = SPDX.search(raw)
        listed = _IDS.get(re.sub(rb"-(only|or-later)$|\+$", b"", named[1].lower())) if named else None
        best, of = (1.0, listed) if listed else (0.0, None)
        terms = terms_of(raw)
        if not self.needed.isdisjoint(terms):
            passages = {p for p in _SENTENCE.split(raw) if p}
            passages |= {p for p in raw.split(b"\n") if p} | {p for p in _PARAGRAPH.split(raw) if p}
            for passage in sorted(passages):
                if not self.needed.isdisjoint(terms_of(passage)):
                    score, name = self.nearest(passage)
                    if score > best:
                        best, of = score, name
        whole, name = self.nearest(raw) if best >= PASSAGE or not self.needed.isdisjoint(terms) else (0.0, None)
        if whole >= FILE and not listed:
            best, of = whole, name
        return (of, best, whole >= FILE) if best >= PASSAGE else (None, best, False)


def scan(files: DataFrame) -> DataFrame:
    """path, license, score, origin for every row of ``files`` (path, text), and its other columns.

    origin is "own", "inherited" or null where no license was found; score is the cosine of the
    passage, of the license file's for inherited ones. A null text has none of its own; a null path
    has no directory and inherits nothing. Repeated rows get equal results. The license of a
    directory is that of its license file with the highest score, then the least path. Columns of
    ``files`` may have any names; license, score and origin are replaced, and text is left out. No
    rows give no rows.
    """
    kept = [c for c in files.columns if c not in ("license", "score", "origin", "text")]
    matcher = Matcher(*document_frequencies(files))

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([matcher.scan(t) for t in texts], columns=["license", "score", "is_file"])

    found = F.pandas_udf(run, "license string, score double, is_file boolean")("text")
    own = files.select(F.struct(*kept).alias("row"), F.col("path").cast("string").alias("path"), found.alias("found"))
    named = F.coalesce(F.regexp_like("path", F.lit(NAMES)) & F.col("found.license").isNotNull(), F.lit(False))
    own = cut(own.select("row", "path", "found.license", "found.score", (F.col("found.is_file") | named).alias("file"), F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")))
    best = F.min(F.struct((-F.col("score")).alias("low"), "path", "license")).alias("best")
    holders = own.where("file and dir is not null").groupBy(F.col("dir").alias("holder")).agg(best)
    holders = holders.select("holder", F.col("best.license").alias("up_license"), (-F.col("best.low")).alias("up_score"))
    parts = F.split("dir", "/")
    upward = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("holder")))
    folders = own.where("dir is not null and license is null").select("dir").distinct()
    climbed = folders.select("dir", F.explode(upward).alias("u")).select("dir", "u.depth", "u.holder")
    nearest = climbed.join(holders, "holder").groupBy("dir").agg(F.max(F.struct("depth", "up_license", "up_score")).alias("up"))
    salted = nearest.select(F.col("dir").alias("folder"), "up.up_license", "up.up_score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = own.withColumn("of", F.when(F.col("license").isNull(), F.pmod(F.xxhash64("path", "score"), F.lit(SALTS)).cast("int")))
    joined = rows.join(salted, (F.col("dir") == F.col("folder")) & (F.col("of") == F.col("salt")), "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        "row.*", F.coalesce("license", "up_license").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(mine, "own").when(F.col("up_license").isNotNull(), "inherited").alias("origin"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each at source/<id in hundreds>/<id>."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "license", "score", "origin")

"""Operator 1 [native]: license scans by MinHash bands over overlapping text windows.

Texts and templates are lower-cased, their words are the runs of letters a-z and digits, and shingles are five words
in a row. Windows of a text begin every fourth shingle and hold 12 shingles, for long templates, or every second and
hold 4, for short ones; a template of under four shingles is looked up by windows of one. Templates have their windows
at every shingle. A window's MinHash i is its least shingle hash after XOR with a constant of its own; a band is one
MinHash, and windows that agree in a band retrieve the template. If the minima were independent, windows with Jaccard
similarity j would agree in one of the 12 bands with probability 1 - (1 - j)^12, 0.99 from j = 0.32 on; a window within
a copy has j of 0.6 or more, and a copy lies in several windows. The constants differ in their first bits, so that the
minima are of different shingles, but they are not independent; README has the recall as measured against comparing
all shingles.

Retrieved pairs of text and template are verified, and they alone: the text's five-word shingles, as texts, are
compared with the template's, and a license is found where LEAST of its shingles are there.

Only DataFrame operations. Windows and bands are rows of generators, so least hashes run in generated code; a text goes
along unread to where a window matches. The template tables are broadcast while the templates have at most
MOST_CHARACTERS, and joined as Spark chooses beyond.

Defined cases: null and empty text and texts under five words have no license; null doc_id is a document of its own;
rows with equal doc_id count as one document, whose shingles are those of the rows that a template is retrieved for;
further columns are ignored; an empty table gives no rows. Only the letters A-Z are lowered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, LEAST = 5, 0.8
#: License notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
STRIDE, LONG, SHORT = 4, 12, 4
MOST_CHARACTERS = 1 << 20
#: Constants that differ in their first bits, so that each picks a minimum of its own.
BANDS = [(((2 * i + 1) << 59) ^ (0x9E3779B97F4A7C15 * (i + 1))) % (1 << 64) for i in range(12)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words(text: Column) -> Column:
    """lower() would make the letters a-z of two others; they are no letters here."""
    for other in "\u212a\u0130":
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(w: str) -> Column:
    """Hashes of all five-word shingles of a column of words."""
    return F.expr(f"if(size({w}) < {SHINGLE}, array(), transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])))")


def _texts(w: str) -> Column:
    """All five-word shingles as texts."""
    return F.expr(f"if(size({w}) < {SHINGLE}, cast(array() as array<string>), transform(sequence(0, size({w}) - {SHINGLE}), i -> concat_ws(' ', slice({w}, i + 1, {SHINGLE}))))")


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, w, sh (hashes), n (number of shingles)."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("t")) for k, v in sorted(texts.items())))
    return spark.range(1).select(F.inline(rows)).select("license", words(F.col("t")).alias("w")).withColumn("sh", _shingles("w")).withColumn("n", F.size("sh"))


def _least(first: int, length: int) -> Column:
    return F.least(*(F.col(f"h{i}").bitwiseXOR(F.col("c")) for i in range(first, first + length)))


def _banded(rows: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """rows: sh and what to keep. One row (length, band, least) for each window and band; there is no filter on sh, which would be pushed down and compute it again."""
    starts = rows.select(*keep, "sh", F.explode(F.expr(f"sequence(0, greatest(size(sh) - 1, 0), {stride})")).alias("at"))
    here = starts.select(*keep, *(F.expr(f"get(sh, at + {i})").alias(f"h{i}") for i in range(LONG)))
    each = here.select("*", F.posexplode(F.array(*(F.lit(_signed(x)) for x in BANDS), F.lit(0).cast("long"))).alias("band", "c"))
    single = F.col("band") == len(BANDS)
    windows = [(LONG, _least(0, LONG)), (SHORT, _least(0, SHORT)), (SHORT, _least(2, SHORT))] if stride == STRIDE else [(LONG, _least(0, LONG)), (SHORT, _least(0, SHORT))]
    values = F.array(*(F.struct(F.when(single, 1).otherwise(length).alias("length"), F.when(single, F.col(f"h{i}")).otherwise(least).alias("least")) for i, (length, least) in enumerate(windows)), *(F.struct(F.lit(1).alias("length"), F.when(single, F.col(f"h{i}")).alias("least")) for i in range(len(windows), stride)))
    return each.select(*keep, "band", F.inline(values)).where("least is not null")


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment: one row for each document and license found in it."""
    texts = TEMPLATES if texts is None else texts
    known = templates(docs.sparkSession, texts)
    small = F.broadcast if sum(map(len, texts.values())) <= MOST_CHARACTERS else lambda df: df
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("w", words(F.col("text")))
    length = F.when(F.col("n") >= LONG, LONG).when(F.col("n") >= SHORT, SHORT).otherwise(1)
    table = _banded(known, ["license", "n"], 1).where(F.col("length") == length).select("license", "length", "band", "least").distinct()
    signed = _banded(rows.select("doc_id", "text", _shingles("w").alias("sh")), ["doc_id", "text"], STRIDE)
    # the first of the windows of a text that retrieve a template is enough; equal ones go before the shuffle
    retrieved = signed.join(small(table), ["length", "band", "least"]).select("doc_id", "text", "license").distinct()
    wanted = known.select("license", F.array_distinct(_texts("w")).alias("all")).select("license", F.size("all").alias("of"), F.explode("all").alias("shingle"))
    shingles = retrieved.select("doc_id", "license", words(F.col("text")).alias("w")).select("doc_id", "license", F.explode(_texts("w")).alias("shingle"))
    inside = shingles.join(small(wanted), ["license", "shingle"]).select("doc_id", "license", "of", "shingle").distinct()
    verified = inside.groupBy("doc_id", "license", "of").agg(F.count("*").alias("n")).where(F.col("n") >= least * F.col("of"))
    return verified.select("doc_id", "license", F.round(F.col("n") / F.col("of"), 6).alias("containment"))


def scan_sql(texts: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """DuckDB SQL for scan() over documents, by comparing all shingles."""
    listed = ", ".join(f"('{k}', '{v.lower()}')" for k, v in sorted(texts.items()))
    split = "list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda w: w <> '')"
    zipped = "unnest(list_zip(" + ", ".join("w" if i == 0 else f"w[{i + 1}:]" for i in range(SHINGLE)) + ", true)) AS z"
    shingle = " || ' ' || ".join(f"z[{i + 1}]" for i in range(SHINGLE)) + " AS shingle"
    return f"""
        WITH t AS (SELECT license, {split.format("t")} AS w FROM (VALUES {listed}) AS v(license, t)),
        ts AS (SELECT DISTINCT license, {shingle} FROM (SELECT license, {zipped} FROM t)),
        n AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
        d AS (SELECT doc_id, {split.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents WHERE text IS NOT NULL),
        ds AS (SELECT doc_id, {shingle} FROM (SELECT doc_id, {zipped} FROM d WHERE len(w) >= {SHINGLE})),
        hits AS (SELECT DISTINCT doc_id, license, shingle FROM ds JOIN ts USING (shingle)),
        c AS (SELECT doc_id, license, count(*) AS found FROM hits GROUP BY doc_id, license)
        SELECT doc_id, license, round(CAST(found AS DOUBLE) / n, 6) AS containment FROM c JOIN n USING (license) WHERE found >= {least} * n"""

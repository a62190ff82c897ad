"""Licence scans: TF-IDF cosine of notice lines to templates, then inheritance along directories.

Every line of a text that has a marker word (licence, license, licensed, copyright, ...) is a notice
line. Its words, weighted by TF-IDF over all notice lines, are compared with those of the templates; the
best one at ``THRESHOLD`` or more names the line's licence, and the best line the file's own licence. A
file at ``a/b/c`` speaks for the directory ``a/b``; of several the one most like its template does. A
file without one inherits from the nearest directory above it that has one.

All of it is joins and aggregates. Only notice lines are taken apart. Directories inherit, not files, so
a root that a third of all files lie under is looked up once per directory, not once per file.

Edge cases: a null text has no lines; a null path has no directory and inherits nothing; of equal
cosines the template's name, then the smaller path and id decide; repeated rows answer alike. Without
notice lines nothing has a licence. Only the id, path and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm.store import stored

THRESHOLD = 0.7

MARKERS = ("license", "licence", "licensed", "licenced", "copyright", "copyrighted", "spdx")

#: Short notices of common public licences (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense license"),
)

_WORD = "[a-z0-9]+"
_HAS_MARKER = "(^|[^a-z0-9])(" + "|".join(MARKERS) + ")([^a-z0-9]|$)"


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _weights(terms: DataFrame, key: list[str], idf: DataFrame, rarest: float) -> DataFrame:
    """Per key and term: TF x IDF; a term that no notice line has weighs as one that is in none."""
    tf = terms.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    return tf.join(idf, "term", "left").select(*key, "term", (F.col("tf") * F.coalesce("idf", F.lit(rarest))).alias("w"))


def notices(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, path, license, similarity): the best notice line of each file that has one like a template."""
    marked = docs.where(F.lower("text").rlike(_HAS_MARKER))
    lines = marked.select("id", "path", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = stored(lines.where(F.lower("content").rlike(_HAS_MARKER)), "notices")
    terms = lines.select("id", "path", "line", F.explode(_words("content")).alias("term"))
    total = lines.count()
    idf = terms.distinct().groupBy("term").agg((F.log(F.lit(1 + total) / (1 + F.count("*"))) + 1).alias("idf"))
    rarest = math.log(1 + total) + 1
    templates = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(notice).alias("notice")) for name, notice in TEMPLATES))
    patterns = spark.range(1).select(F.inline(templates)).select("license", F.explode(_words("notice")).alias("term"))
    pattern = _weights(patterns, ["license"], idf, rarest).withColumnRenamed("w", "pw")
    norm = pattern.groupBy("license").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pnorm"))
    line = _weights(terms, ["id", "path", "line"], idf, rarest)
    size = line.groupBy("id", "path", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = line.join(pattern, "term").groupBy("id", "path", "line", "license").agg(F.sum(F.col("w") * F.col("pw")).alias("dot"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("id", "path", "line")]
    cosine = dot.alias("d").join(size.alias("s"), same).join(norm, "license")
    cosine = cosine.select("d.id", "d.path", "license", F.round(F.col("dot") / (F.col("norm") * F.col("pnorm")), 6).alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "license")).alias("b")
    likely = cosine.where(F.col("similarity") >= THRESHOLD).groupBy("id", "path").agg(best)
    return stored(likely.select("id", "path", "b.license", (-F.col("b.far")).alias("similarity")), "licensed")


def _directory(path):
    """What stands before the last slash; null for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def scan(docs: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Per file: id, path, its own licence with the similarity, the licence that holds, and the directory it came from."""
    spark = docs.sparkSession
    files = docs.select(F.col(id_column).alias("id"), F.col(path_column).alias("path"), F.col(text_column).alias("text"))
    own = notices(files, spark)
    speaks = F.min(F.struct((-F.col("similarity")).alias("far"), "license", "path", "id")).alias("b")
    licensed = own.withColumn("directory", _directory(F.col("path"))).where("directory IS NOT NULL")
    licensed = licensed.groupBy("directory").agg(speaks).select(F.col("directory").alias("above"), F.col("b.license").alias("given"))
    held = files.select("id", "path").withColumn("directory", _directory(F.col("path")))
    parts = F.split("directory", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    chains = held.select("directory").where("directory IS NOT NULL").distinct().select("directory", F.explode(chain).alias("c"))
    nearest = chains.select("directory", "c.depth", "c.above").join(licensed, "above").groupBy("directory").agg(
        F.max(F.struct("depth", "above", "given")).alias("n")
    )
    resolved = nearest.select("directory", F.col("n.above").alias("inherited_from"), F.col("n.given").alias("given"))
    answers = held.join(resolved, "directory", "left").alias("h")
    found = answers.join(own.alias("o"), F.col("h.id").eqNullSafe(F.col("o.id")) & F.col("h.path").eqNullSafe(F.col("o.path")), "left")
    return found.select(
        F.col("h.id").alias(id_column),
        F.col("h.path").alias(path_column),
        F.col("o.license").alias("own_license"),
        "o.similarity",
        F.coalesce("o.license", "given").alias("license"),
        F.when(F.col("o.license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )

"""License scan by canonical digest.

A text is made canonical: lower case, lines that only state a copyright dropped, everything but letters and digits
a single space, and equivalent spellings brought to one. The SHA-256 of what is left is joined to the digests of known licences.
Entire texts are joined, and so is every line of a text taken as a text of its own, which finds licence statements in longer documents.

Null texts have no digest and no licence; empty texts have the digest of nothing, which no licence has. Copies agree. Known licences that are canonically
equal count under the smallest name. The table of known licences is small by nature; it is broadcast only if its counted rows are
at most `BROADCAST_ROWS`.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import field, table

BROADCAST_ROWS = 100_000

#: Public licence statements and short licence texts, with their SPDX names. Whole licences and their headers are in
#: known_licenses.json, with and without titles, "All rights reserved", numbers of clauses, and appendix.
KNOWN = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
}

#: Spellings that licence guidelines call equivalent, to one of each.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "organisation": "organization",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "honour": "honor",
    "analyse": "analyze",
    "artefact": "artifact",
    "per cent": "percent",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "merchantibility": "merchantability",
    "copyright owner": "copyright holder",
    "https": "http",
}

_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9])[^\n]*"
#: Wider than what the SQL takes for a copyright line: names before or without a year, and colons. Words that go on after "copyright"
#: in licences themselves, where lines may break anywhere, do not begin a name.
_CLAUSE = r"(?:holders?|owners?|notices?|licen[sc]es?|laws?|treat(?:y|ies)|statements?|interests?|acts?|rights?|protection|and|or|to|in|is|of|for|on|as|applies)\b"
_NAMED = (
    r"by[ \t]|[:,][ \t]*[^\n]*[0-9]{4}|(?![ \t]*" + _CLAUSE + r")[^\n]*\b(?:19|20)[0-9]{2}\b"
    r"|the[ \t](?:[^\n]*[ \t])?(?:authors?|contributors?|developers?|maintainers?|team)[ \t.]*(?=\n|$)"
)
_COPYRIGHT_LINE = _COPYRIGHT[: -len(r"(\(c\)|©|[0-9])[^\n]*")] + r"(?:\(c\)|©|[0-9]|" + _NAMED + r")[^\n]*"


def canonical(text: Column) -> Column:
    """The text as it is compared. Characters outside ASCII stay, as they tell texts apart."""
    low = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "\n")
    low = F.concat(F.lit(" "), F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    for old, new in SPELLINGS.items():
        low = F.replace(low, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(low)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def whole_licenses() -> dict[str, list[str]]:
    """Full texts and common headers of public licences, with their SPDX names."""
    return json.loads(resources.files("larkspur.llm").joinpath("known_licenses.json").read_text(encoding="utf-8"))


def known_licenses(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license) of known texts."""
    listed = [known] if known else [KNOWN, whole_licenses()]
    rows = [(name, text) for some in listed for name, texts in some.items() for text in texts]
    listed = spark.createDataFrame(rows, "license string, text string").withColumn("digest", digest(F.col("text")))
    return listed.groupBy("digest").agg(F.min("license").alias("license"))


def scan(df: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `df`: the key, digest, license (of the entire text) and line_licenses (names, in order, by commas)."""
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    named = df.select(field(key).alias("__key"), field(text).alias("__text"), F.xxhash64(field(text)).alias("__of"))
    # only lines with a letter or digit can be licences; each is digested once, and only the few that match move
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    hits = named.select("__key", "__of", F.explode(F.transform(lines, digest)).alias("digest")).join(known, "digest")
    per_text = hits.groupBy("__key", "__of").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"))
    whole = named.select("__key", "__of", digest(F.col("__text")).alias("digest")).join(known, "digest", "left")
    same = F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__of") == F.col("__of2"))
    joined = whole.join(per_text.withColumnsRenamed({"__key": "__key2", "__of": "__of2"}), same, "left")
    return joined.select(F.col("__key").alias(key), "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and licences of every document."""
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """The same steps in DuckDB's functions."""
    low = f"regexp_replace(lower({text}), {_sql_text(_COPYRIGHT)}, chr(10), 'g')"
    low = f"(' ' || regexp_replace({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') || ' ')"
    for old, new in SPELLINGS.items():
        low = f"replace({low}, ' {old} ', ' {new} ')"
    return f"sha256(trim({low}, ' '))"


_VALUES = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, texts in KNOWN.items() for text in texts)

QUERIES = {"op6_license_digests": op6_license_digests}
ORACLE = {
    "op6_license_digests": f"""
WITH listed(license, text) AS (VALUES {_VALUES}),
known AS (SELECT {_sql_canonical("text")} AS digest, min(license) AS license FROM listed GROUP BY ALL),
named AS (SELECT row_number() OVER () AS n, doc_id, text, {_sql_canonical("text")} AS digest FROM documents),
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM named),
hits AS (SELECT DISTINCT n, license FROM lines JOIN known ON known.digest = {_sql_canonical("line")}),
per_text AS (SELECT n, string_agg(license, ',' ORDER BY license) AS line_licenses FROM hits GROUP BY n)
SELECT doc_id, named.digest, license, coalesce(line_licenses, '') AS line_licenses
FROM named LEFT JOIN known ON known.digest = named.digest LEFT JOIN per_text USING (n)"""
}

"""Licence scan over whole texts: a positional rare-token index, with DataFrame operations only.

Templates are phrases; a label counts only if all of its mandatory phrases stand in the file. The index has a posting for each
template word: word, template, relative position, idf, from document frequencies over all documents. A file is read once,
for the places of template words. Each template is looked up by its highest-IDF word; where the file has it, the places at
which the template could start, place less relative position, are intersected with those of its other words, in falling order
of their IDF: what is left are places at which all words agree.

The score is the share of the templates' IDF that stands in the file: rare words count more than common ones.

Words are runs of ASCII letters, digits and non-ASCII characters, after A-Z are lower-cased.

Defined cases: a null or empty text has no words and no labels; an empty table gives no rows; repeated
rows are scanned each for itself; rows with a null doc_id are scanned like others; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words, base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, phrases): all the phrases have to stand in the file.
EXTRA = [
    ("mit", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("mit", ("mit license",)),
    ("apache-2.0", ("apache license", "version 2 0")),
    ("bsd", ("redistribution and use in source and binary forms",)),
    ("lgpl", ("lesser general public license",)),
    ("agpl", ("affero general public license",)),
    ("mpl", ("mozilla public license",)),
    ("isc", ("permission to use copy modify and or distribute this software",)),
    ("cc0", ("cc0 1 0 universal",)),
    ("cc-by-sa", ("cc by sa",)),
    ("cc-by-nc", ("cc by nc",)),
    ("cc-by-nd", ("cc by nd",)),
    ("public-domain", ("public domain",)),
    ("spdx", ("spdx license identifier",)),
    ("copyright", ("copyright c",)),
]
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases() -> list[str]:
    """The templates: every phrase once, in a fixed order."""
    return list(dict.fromkeys([*BASE, *(p for _, ps in EXTRA for p in ps)]))


def _words(docs: DataFrame) -> DataFrame:
    line = F.trim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), SEPARATOR, " "))
    words = F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))
    return docs.select("doc_id", words.alias("words"))


def vocabulary() -> list[str]:
    return sorted({w for p in phrases() for w in p.split(" ")})


def located(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, found array<struct(word, i)>: the places of all template words, in one pass, written."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    marked = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i")))
    found = F.when(F.arrays_overlap("words", known), F.filter(marked, lambda x: F.array_contains(known, x["word"])))
    rows = _words(docs).select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(found, F.array().cast("array<struct<word:string,i:int>>")).alias("found"))
    return settle(rows, "licence-words")


def inverse_frequency(rows: DataFrame) -> dict[str, float]:
    """ln((n + 1) / (df + 1)) of each template word over all documents: partial sums, a row a template word."""
    n, seen = rows.count(), F.array_distinct(F.transform("found", lambda x: x["word"]))
    df = {r["word"]: r["count"] for r in rows.select(F.explode(seen).alias("word")).groupBy("word").count().collect()}  # at most len(vocabulary())
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}


def places(phrase: str, idf: dict[str, float]) -> Column:
    """Where the phrase starts: the places at which all of its postings agree, the rarest word's looked up first."""
    words = phrase.split(" ")
    order = sorted(range(len(words)), key=lambda k: (-idf[words[k]], k))
    starts = lambda k: F.transform(F.filter("found", lambda x: (x["word"] == words[k]) & (x["i"] >= k)), lambda x: x["i"] - F.lit(k))
    first = starts(order[0])
    return F.when(F.size(first) > 0, reduce(F.array_intersect, map(starts, order[1:]), first)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, hits array<struct(phrase, start)>, labels array<string>, base_labels, score.

    Nothing is shuffled but the word counts: the index is a constant of the plan and a file's places stay in its row. Files
    without any look-up word, nearly all, pass by the index.
    """
    rows = located(docs)
    idf = inverse_frequency(rows)
    rarest = {max(p.split(" "), key=lambda w: (idf[w], -p.split(" ").index(w))) for p in phrases()}
    named = lambda p: F.transform(places(p, idf), lambda s: F.struct(F.lit(p).alias("phrase"), s.cast("long").alias("start")))
    hit = F.flatten(F.array(*map(named, phrases())))
    none = F.array().cast("array<struct<phrase:string,start:bigint>>")
    hits = F.when(F.exists("found", lambda x: x["word"].isin(*sorted(rarest))), hit)
    out = rows.withColumn("hits", F.coalesce(hits, none)).withColumn("have", F.array_distinct(F.transform("hits", lambda h: h["phrase"])))
    weight = {p: sum(idf[w] for w in p.split(" ")) for p in phrases()}
    whole = math.fsum(weight.values())
    share = sum((F.when(F.array_contains("have", p), w).otherwise(0.0) for p, w in weight.items()), F.lit(0.0)) / whole if whole > 0 else F.lit(0.0)
    base = F.array_compact(F.array(*[F.when(F.array_contains("have", p), F.lit(label)) for p, label in BASE.items()]))
    more = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("have", F.array(*[F.lit(p) for p in ps]))) == len(ps), F.lit(label)) for label, ps in EXTRA]))
    return out.select("doc_id", "n_words", "hits", F.array_sort(F.array_distinct(base)).alias("base_labels"), F.array_sort(F.array_union(base, more)).alias("labels"), F.least(share, F.lit(1.0)).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts and places of the base phrases, labels, and the share of IDF, to nine places."""
    starts = F.transform(F.filter("hits", lambda h: h["phrase"].isin(*BASE)), lambda h: h["start"])
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        F.round("score", 9).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for digest(): regular expressions over the words joined by single spaces."""
    q = lambda p: f"(' ' || t || ' ') LIKE '% {p} %'"
    # doubling the spaces lets neighbouring places both match
    count = " + ".join(f"len(regexp_extract_all(t2, ' {p.replace(' ', '  ')} '))" for p in BASE)
    starts = ", ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{p.split(' ')[0]}' AND array_to_string(w[i:i + {len(p.split(' ')) - 1}], ' ') = '{p}'), lambda i: i - 1)" for p in BASE)
    base = ", ".join(f"CASE WHEN {q(p)} THEN '{label}' END" for p, label in BASE.items())
    more = ", ".join(f"CASE WHEN {' AND '.join(map(q, ps))} THEN '{label}' END" for label, ps in EXTRA)
    part = lambda p: " + ".join(f"ln((n + 1) / (coalesce(df['{w}'], 0) + 1))" for w in p.split(" "))
    found, whole = " + ".join(f"CASE WHEN {q(p)} THEN {part(p)} ELSE 0 END" for p in phrases()), " + ".join(map(part, phrases()))
    tidy = lambda x: f"list_sort(list_distinct(list_filter([{x}], lambda x: x IS NOT NULL)))"
    return f"""
WITH a AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS t FROM documents),
b AS (SELECT doc_id, t, ' ' || replace(t, ' ', '  ') || ' ' AS t2, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM a),
f AS (SELECT map(list(x), list(k)) AS df, (SELECT count(*) FROM b) AS n FROM (SELECT x, count(*) AS k FROM (SELECT unnest(list_distinct(list_intersect(w, [{', '.join(f"'{w}'" for w in vocabulary())}]))) AS x FROM b) GROUP BY x)),
g AS (SELECT b.*, f.df, f.n, {whole} AS whole FROM b, f),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, ({count})::BIGINT AS n_base,
    CASE WHEN whole > 0 THEN round(least(({found}) / whole, 1.0), 9) ELSE 0.0 END AS score, CASE WHEN {count} > 0 THEN flatten([{starts}]) ELSE [] END AS st, {tidy(base)} AS bl, {tidy(base + ', ' + more)} AS al FROM g)
SELECT doc_id, n_words, n_base, list_min(st)::BIGINT AS first_word, list_max(st)::BIGINT AS last_word,
    coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, score::DOUBLE AS score FROM c
"""

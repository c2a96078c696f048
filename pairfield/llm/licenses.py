"""License scans: an exact containment join between text blocks and licence templates.

A block is any run of consecutive words of the text, across lines, as long as the template allows: the template's words
divided by the threshold. A block matches if it holds at least ``need`` of the template's distinct tokens.

Template tokens are put in one global order, rarest first, by document frequency over the whole table. A matching block
holds one of the template's prefix tokens (the rarest ``size - need + 1``), so only blocks around their places are looked
at; of these only such that begin with a token of the template, as others hold no more than the next one that does, and
that are long enough (length filter) and begin early enough before the prefix token and the text's end to hold ``need``
tokens (positional filter). Then tokens are counted. Templates and base phrases are parameters; both are short lists (some
dozens of notices), so they travel as literals and the join needs no shuffle; only the frequencies (at most one row per
template token) are gathered.

Beside the method's labels the scan reports every place where a base phrase stands word by word.

Nulls and edges: a null or empty text has no words, no labels and score 0; repeated rows are scanned each on its own; an
empty table leaves the order to the alphabet; further columns are passed on by ``scan(..., keep=...)`` only,
with ``_in`` behind names that are results of the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, kept, table

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices in public use and their labels.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8


def _tokens(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, APART), "")


def checked(templates: Iterable[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """(label, notice) pairs, each notice as its words in lower case."""
    out = tuple((label, " ".join(w for w in re.split(APART, notice.translate(_LOWER)) if w)) for label, notice in templates)
    if any(not notice for _, notice in out):
        raise ValueError("a notice has a word at least")
    return out


def token_order(df: DataFrame, text: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES) -> list[str]:
    """Template tokens, rarest first, by the number of documents that hold them; ties by code point."""
    vocabulary = sorted({w for _, notice in checked(templates) for w in notice.split()})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), _tokens(ascii_lower(F.coalesce(F.col(text), F.lit("")))))
    counts = df.select(F.explode(held).alias("token")).groupBy("token").count()
    n = {r["token"]: r["count"] for r in counts.collect()}  # at most len(vocabulary) rows
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _starts(w: Column, phrases: dict[str, str]) -> Column:
    """(start, label) of each base phrase in a word array."""
    cases = None
    for phrase, label in phrases.items():
        first, *rest = phrase.split()
        # tested from the phrase's last word, which is the rarer one to look for
        at = lambda x, i, rest=rest, first=first, phrase=phrase: (x == rest[-1]) & (F.get(w, i - len(rest)) == first) & (F.array_join(F.slice(w, F.greatest(i - len(rest), F.lit(0)) + 1, len(rest) + 1), " ") == phrase)
        cases = [*(cases or []), (at, label, len(rest))]

    def found(x: Column, i: Column) -> Column:
        out = None
        for at, label, back in cases:
            value = F.struct((i - back).alias("start"), F.lit(label).alias("label"))
            out = F.when(at(x, i), value) if out is None else out.when(at(x, i), value)
        return out

    return F.filter(F.transform(w, found), lambda x: x.isNotNull())


def _templates(order: list[str], threshold: float, templates: Iterable[tuple[str, str]]) -> list[tuple[str, list[str], int, list[str], int]]:
    """(label, tokens rarest first, need, prefix, most words of a block)."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, notice in checked(templates):
        tokens = sorted(set(notice.split()), key=rank.__getitem__)
        need = ceil(round(threshold * len(tokens), 9))
        out.append((label, tokens, need, tokens[: len(tokens) - need + 1], width(notice, threshold)))
    return out


def width(notice: str, threshold: float = THRESHOLD) -> int:
    return ceil(round(len(notice.split()) / threshold, 9))


def scan(df: DataFrame, order: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``keep``, n_words, places (start, label) and matches (start, words, label, containment): all blocks, by their first word.

    ``templates`` are (label, notice) pairs, the ones that ``order`` was made of, and ``phrases`` map base phrases of two words or more, in
    lower case, to labels.
    """
    templates = _templates(order, threshold, templates)
    prefixes = sorted({w for _, _, _, prefix, _ in templates for w in prefix})
    every = F.array(*map(F.lit, prefixes))
    kind = "array<struct<start:int,words:int,label:string,containment:double>>"

    def of_template(w: Column, at: Column, label: str, tokens: list[str], need: int, prefix: list[str], most: int) -> Column:
        t, own = F.array(*map(F.lit, tokens)), F.array(*map(F.lit, prefix))
        around = F.filter(at, lambda q: F.array_contains(own, F.get(w, q)))
        begins = F.transform(around, lambda q: F.filter(F.sequence(F.greatest(q - (most - 1), F.lit(0)), q), lambda p: F.array_contains(t, F.get(w, p)) & (F.size(w) - p >= need)))
        held = lambda p: F.size(F.array_intersect(t, F.slice(w, p + 1, most))) / F.lit(len(tokens))
        counted = F.transform(F.array_distinct(F.flatten(begins)), lambda p: F.struct(p.alias("start"), F.least(F.lit(most), F.size(w) - p).alias("words"), F.lit(label).alias("label"), held(p).alias("containment")))
        return F.filter(counted, lambda x: x["containment"] * len(tokens) > need - 0.5)

    def matches(w: Column, at: Column) -> Column:
        return F.flatten(F.array(*[of_template(w, at, *x) for x in templates])).cast(kind)

    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    passed, out = kept(keep, ("n_words", "places", "matches"))
    a = df.select(passed, low.alias("__t")).withColumn("__w", _tokens(F.col("__t")))
    joined = F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))
    any_phrase = joined.rlike(f" ({'|'.join(phrases)}) ")
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    # most texts hold no prefix token at all
    any_prefix = F.col("__t").rlike(rf"(?<![0-9a-z])({'|'.join(prefixes)})(?![0-9a-z])")
    places = F.filter(F.transform("__w", lambda x, i: F.when(F.array_contains(every, x), i)), lambda i: i.isNotNull())
    a = a.withColumn("__at", F.when(any_prefix, places).otherwise(F.expr("cast(array() as array<int>)")))
    pairs = F.when(F.size("__at") > 0, matches(F.col("__w"), F.col("__at"))).otherwise(F.expr(f"cast(array() as {kind})"))
    found = a.select("__kept", F.size("__w").cast("long").alias("__n"), F.when(any_phrase, _starts(F.col("__w"), phrases)).otherwise(none).alias("__p"), pairs.alias("__m"))
    return found.select(*out, F.col("__n").alias("n_words"), F.col("__p").alias("places"), F.col("__m").alias("matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, token_order(docs))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_union(F.col("places.label"), F.col("matches.label")))
    best = F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).cast("long").alias("first_word"), F.array_max(F.col("places.start")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


_P = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_T = ", ".join(f"({i}, '{label}', '{t}', {width(t)})" for i, (label, t) in enumerate(TEMPLATES))
ORACLE = rf"""
WITH p(phrase, label, n) AS (VALUES {_P}),
raw(id, label, notice, width) AS (VALUES {_T}),
t AS (SELECT id, label, width, list_distinct(string_split(notice, ' ')) AS t FROM raw),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
w AS (SELECT r, doc_id, s, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
b AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, list_distinct(list(label)) AS l FROM i, p WHERE w[i:i + n - 1] = string_split(phrase, ' ') GROUP BY r),
x AS (SELECT r, label, len(t) AS size, len(list_intersect(t, w[i:i + width - 1])) AS held FROM i, t WHERE list_contains(t, w[i])),
m AS (SELECT r, list_distinct(list(label)) AS l, max(held / size) AS c FROM x WHERE held >= ceil(round(0.8 * size, 9)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1::DOUBLE ELSE coalesce(m.c, 0)::DOUBLE END AS score
FROM w LEFT JOIN b ON b.r = w.r LEFT JOIN m ON m.r = w.r
"""

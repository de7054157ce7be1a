"""License scan by an exact set-similarity join (native).

Base labels come from fixed phrases. The method then joins the blocks of every
text with license templates: all pairs in which a block holds at least
`percent` of a template's distinct words. A block is 2 * HALF words, the next one
starts HALF words later, so any HALF words in a row lie in one block.

Tokens are ordered by how many texts of the whole corpus hold them, the rarest
first. A template's prefix, its |T| - need + 1 rarest words, must meet the
block's; so only blocks around such words are formed. They are joined on single
prefix tokens, then filtered by length (a block needs `need` template words),
by the block's own prefix, and by position (what can still follow after a common
token). Survivors are verified on the whole sets.

Defined cases: a null text counts as empty; texts without words have counts of
0, no places and no labels. Repeated rows each get their row, with equal values;
null ids are kept; other columns are not read; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Fixed phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Fixed texts: opening sentences of public licenses and their usual short notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Distributed under the terms of the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HALF = 64


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. lower() also changes letters beyond A-Z, but none of
    them to a separator, and only the Kelvin sign to a letter of the phrases or
    templates: another letter stands for it here."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.filter(F.split(F.lower(plain), SEPARATORS), lambda w: w != "")


def template_tokens(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted(set(re.findall(r"[a-z0-9]+", text.lower())))) for label, text in templates]


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def places(words: Column, phrase: str) -> Column:
    """Indices where the phrase's words stand in a row."""
    parts = phrase.split(" ")

    def here(w: Column, i: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, [w == parts[0]] + [F.get(words, i + k) == p for k, p in enumerate(parts) if k]), i)

    found = F.filter(F.transform(words, here), lambda i: i.isNotNull())
    all_there = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts])
    return F.when(all_there, found).otherwise(F.array().cast("array<int>"))


def scan(documents: DataFrame, percent: int = 80, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (1 with a base label, else the best containment found, else 0)."""
    wanted = template_tokens(templates)
    vocabulary = sorted({t for _, tokens in wanted for t in tokens})
    words = documents.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w"))
    held = words.select(F.explode(F.array_intersect("w", _literals(vocabulary))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in held.collect()}  # at most one row for each word of the templates
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}
    sets = [(k, label, sorted(rank[t] for t in tokens)) for k, (label, tokens) in enumerate(wanted)]
    need = {k: -(-percent * len(s) // 100) for k, _, s in sets}
    prefixes = [(s[i], k, label, i, need[k], s) for k, label, s in sets for i in range(len(s) - need[k] + 1)]
    spark = documents.sparkSession
    index = spark.createDataFrame(prefixes, "token int, template int, label string, i int, need int, t array<int>")

    rare = sorted({order[p[0]] for p in prefixes})
    starts = [places(F.col("w"), phrase).alias(f"p{k}") for k, (phrase, _) in enumerate(PHRASES)]
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(rare), F.floor(i / HALF).cast("int"))), lambda t: t.isNotNull())
    tiles = F.array_distinct(F.flatten(F.transform(at, lambda t: F.array(t, F.greatest(t - 1, F.lit(0))))))
    ranks = F.create_map(*[F.lit(x) for t in order for x in (t, rank[t])])
    block = lambda t: F.array_sort(
        F.transform(F.array_intersect(F.slice("w", t * HALF + 1, F.lit(2 * HALF)), _literals(vocabulary)), lambda w: F.element_at(ranks, w))
    )
    near = F.when(F.arrays_overlap("w", _literals(rare)), F.transform(tiles, block)).otherwise(F.array().cast("array<array<int>>"))
    rows = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), *starts, near.alias("blocks"))
    every = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    rows = rows.select(
        "doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(labels).alias("base"), "blocks",
    )
    rows = cut(rows)  # counts, labels and the few blocks around rare words: no text

    b = rows.select("doc_id", "row", F.explode("blocks").alias("b")).select("doc_id", "row", "b", F.posexplode("b").alias("j", "token"))
    size, tsize = F.size("b"), F.size("t")
    pairs = b.join(F.broadcast(index), "token").where(  # the index has a fixed number of rows
        (size >= F.col("need")) & (F.col("j") <= size - F.col("need"))
        & (1 + F.least(tsize - 1 - F.col("i"), size - 1 - F.col("j")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("b", "t"))
    hits = pairs.withColumn("overlap", overlap).where("overlap >= need")
    hits = hits.groupBy(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row")).agg(
        F.collect_set("label").alias("more"), F.max(F.col("overlap").cast("double") / tsize).alias("best")
    )
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["h_id"]) & rows["row"].eqNullSafe(hits["h_row"]), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB, every block against every template."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {quoted(tokens)})" for label, tokens in template_tokens())
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT rid, w, unnest(range(len(w))) AS i FROM w),
b AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM x, (VALUES {phrases}) AS p(parts, label) WHERE w[i + 1] = parts[1] AND w[i + 1 : i + len(parts)] = parts GROUP BY rid),
t AS (SELECT rid, list_distinct(w[k * {HALF} + 1 : k * {HALF} + {2 * HALF}]) AS blk
      FROM (SELECT rid, w, unnest(range((len(w) + {HALF} - 1) // {HALF})) AS k FROM w)),
h AS (
  SELECT rid, label, len(list_intersect(blk, tokens)) AS n, len(tokens) AS size
  FROM t, (VALUES {templates}) AS q(label, tokens)),
m AS (SELECT rid, list(DISTINCT label) AS more, max(n::DOUBLE / size) AS best FROM h WHERE n * 100 >= size * 80 GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""

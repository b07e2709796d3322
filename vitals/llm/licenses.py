"""License scan: phrases by place, and notices by an exact set-similarity join. DataFrame operations only.

A notice matches a text where some block of its words contains enough of the notice's
distinct words. Tokens are ordered by how many documents hold them, rarest first; a block
can only reach the threshold if it holds one of the notice's first |T| - need + 1 tokens
(prefix filter), has `need` notice words at all (length filter), and has enough of them left
from the first that both share (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: phrases that always count, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices, whole or the part that marks them, by label.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission"),
)
THRESHOLD = 0.8
#: A block is twice as long as a step, and begins at each of its multiples; longer notices have steps of twice the last, four times, and so on.
STEPS = (16, 80)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(notice: str) -> list[str]:
    return sorted(set(re.findall(WORD, notice.translate(str.maketrans(UPPER, LOWER)))))


def notices(given: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD) -> list[dict]:
    """Each notice with its distinct tokens, how many a block needs, and its step of blocks."""
    out = []
    for k, (label, text) in enumerate(given):
        t = tokens(text)
        words = len(re.findall(WORD, text.lower()))
        step = next((s for s in STEPS if words <= s), STEPS[-1])
        while step < words:
            step *= 2
        out.append({"notice": k, "label": label, "tokens": t, "need": math.ceil(threshold * len(t) - 1e-9), "step": step})
    return out


def token_order(text: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Ranks of the notices' tokens by the number of documents that hold each, rarest first, ties by token.

    One row per token of the notices comes to the driver, whatever the corpus.
    """
    wanted = F.array(*(F.lit(v) for v in vocabulary))
    held = text.select(F.explode(F.array_intersect(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), wanted)).alias("token"))
    seen = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}


def _any_of(words: list[str]) -> str:
    """A pattern for texts that hold one of these words or phrases, before lower-casing; only A-Z fold."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"(?i)(?<!{RAW})(?:" + "|".join(gap.join(map(re.escape, w.split(" "))) for w in words) + f")(?!{RAW})"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def phrase_places(text: DataFrame) -> DataFrame:
    """Adds places: (at, label) of each phrase, for rows whose text holds one."""
    words = F.when(F.col("text").rlike(_any_of(list(PHRASES))), _words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    out = text.withColumn("words", words)
    places = F.concat(*(_places(phrase.split(" "), name) for phrase, name in PHRASES.items()))
    return out.withColumn("places", places).drop("words")


def _places(phrase: list[str], label: str) -> Column:
    """(at, label) wherever the phrase stands in `words`."""

    def here(word: Column, i: Column) -> Column:
        same = word == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            same = same & (F.get("words", i + k) == w)
        return F.when(same, i)

    return F.transform(F.array_compact(F.transform("words", here)), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def notice_matches(text: DataFrame, known: list[dict]) -> DataFrame:
    """(key, label, containment) of the best block for each notice that a text's blocks match."""
    spark = text.sparkSession
    vocabulary = sorted({t for n in known for t in n["tokens"]})
    rank = token_order(text, vocabulary)
    prefixes, rows = [], []
    for n in known:
        ordered = sorted(n["tokens"], key=rank.__getitem__)
        rows.append((n["notice"], n["label"], ordered, n["need"], n["step"]))
        prefixes += [(t, p, n["notice"]) for p, t in enumerate(ordered[: len(ordered) - n["need"] + 1])]
    # these tables are as large as the notices, whatever the corpus
    notice = F.broadcast(spark.createDataFrame(rows, "notice int, label string, tokens array<string>, need int, step int"))
    prefix = F.broadcast(spark.createDataFrame(prefixes, "token string, place int, of int"))
    order = F.broadcast(spark.createDataFrame(list(rank.items()), "token string, rank int"))

    maybe = text.where(F.col("text").rlike(_any_of(sorted({p[0] for p in prefixes}))))
    placed = maybe.select("key", F.posexplode(_words(F.col("text"))).alias("at", "token")).join(order, "token")
    step = F.explode(F.array(*(F.lit(s) for s in sorted({n["step"] for n in known})))).alias("step")
    blocks = placed.select("key", "at", "token", "rank", step).withColumn("block", F.explode(F.array(F.floor(F.col("at") / F.col("step")), F.floor(F.col("at") / F.col("step")) - 1))).where("block >= 0")
    blocks = blocks.groupBy("key", "step", "block").agg(F.sort_array(F.collect_set(F.struct("rank", "token"))).alias("held"))
    # prefix filter: block tokens by the notices' prefixes, each block and notice once, at the first token they share
    met = blocks.select("key", "step", "block", "held", F.posexplode("held").alias("q", "one")).join(prefix, F.col("one.token") == F.col("token"))
    met = met.groupBy("key", "step", "block", "of").agg(F.min("place").alias("p"), F.min("q").alias("q"), F.first("held").alias("held"))
    met = met.join(notice, F.col("of") == F.col("notice")).where(notice["step"] == blocks["step"])
    size, have = F.size("tokens"), F.size("held")
    met = met.where((have >= F.col("need")) & (1 + F.least(size - F.col("p") - 1, have - F.col("q") - 1) >= F.col("need")))
    common = F.size(F.array_intersect(F.transform("held", lambda x: x["token"]), F.col("tokens")))
    met = met.withColumn("common", common).where("common >= need")
    return met.groupBy("key", "label").agg(F.max(F.col("common") / size).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are of letters, digits and characters outside ASCII, A-Z lower-cased. n_base counts
    the places of PHRASES, first_word and last_word are their smallest and largest start
    (null without one). labels adds those of the notices that a block matches. score is 1
    with a phrase, else the best containment of a matching notice, else 0.

    A null or empty text has no words, no labels and score 0; a very long text is worked on in
    blocks. Repeated rows get equal results; of blocks that tie for a notice any stands for it;
    a null id stays null; other columns are left out; an empty table gives an empty table.
    Texts stay where they are read: what is shuffled are the notice words of the few texts
    with a rare notice word, and one row per document.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text"))))
    matches = notice_matches(text, notices(given, threshold))
    matches = matches.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = phrase_places(text).select("key", "doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({RAW}+)"), F.lit(1))).cast("long").alias("n_words"), "places")
    at = F.transform("places", lambda x: x["at"])
    own = F.array_distinct(F.transform("places", lambda x: x["label"]))
    return base.join(matches, "key", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_sql() -> str:
    """The same in DuckDB SQL, each block against each notice."""
    rows = ",\n".join(f"('{n['label']}', [{', '.join(repr(t) for t in n['tokens'])}], {n['need']}, {n['step']})" for n in notices())
    places = "\nUNION ALL ".join(
        f"SELECT key, i - 1 AS pos, '{name}' AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(" "))) for phrase, name in PHRASES.items()
    )
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
        w AS (SELECT * FROM t WHERE len(words) > 0),
        p AS ({places}),
        n(label, tokens, need, step) AS (VALUES {rows}),
        b AS (SELECT key, s.step, list_distinct(words[k * s.step + 1 : k * s.step + 2 * s.step]) AS held
              FROM w, (SELECT DISTINCT step FROM n) AS s, unnest(range(0, (len(words) - 1) // s.step + 1)) AS u(k)),
        m AS (SELECT key, label, max(len(list_intersect(held, tokens)) / len(tokens)) AS c FROM b JOIN n USING (step)
              WHERE len(list_intersect(held, tokens)) >= need GROUP BY key, label),
        pp AS (SELECT key, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY key),
        al AS (SELECT key, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT key, label FROM p UNION SELECT key, label FROM m) GROUP BY key),
        mm AS (SELECT key, max(c) AS best FROM m GROUP BY key)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
        FROM t LEFT JOIN pp USING (key) LEFT JOIN al USING (key) LEFT JOIN mm USING (key)"""

"""License scans by diagonal voting.

Every text is a sequence of words, every template too. All rolling word k-grams of the texts are joined by hash with the
positions of the templates' k-grams (a table bounded by the templates); each match votes for its diagonal, the text position
at which the template would start. Votes are counted by diagonal, neighbouring diagonals are merged (words put in or left
out move a template by a few places), and a merged span counts if enough of the template's k-grams were seen and the span
is about as long as the template. Votes are checked word by word before they count, so hashes only find candidates.

A short phrase is a template too: all its k-grams on one diagonal mean that its words stand there consecutively.

Nulls: a null text is empty and has no words; a null id is an id like any other. Rows that repeat id and text are one
document. Texts shorter than a k-gram match nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayside.llm.text import ascii_lower, let, whole, words

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
EVERY = -1  # template id of the one vote that every document gets, so that none is lost by the join

#: Phrases that name a license exactly.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Openings of well-known license notices.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "apache-2": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation""",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-3": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission""",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
    "epl-2": "made available under the terms of the Eclipse Public License 2.0",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software""",
}
#: Identifiers in one-line declarations.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2",
    "ISC": "isc", "Unlicense": "unlicense",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool  # every word must stand there, on one diagonal

    @property
    def grams(self) -> int:
        return len(self.words) - GRAM + 1


def split_words(text: str) -> tuple[str, ...]:
    """The words of a template, by the rule that texts are split by."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return tuple(w for w in re.split(BETWEEN, lowered) if w)


def templates(
    phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, identifiers: dict[str, str] = IDENTIFIERS
) -> list[Template]:
    found = [Template(label, split_words(text), True) for text, label in phrases.items()]
    found += [Template(label, split_words(text), False) for label, text in notices.items()]
    found += [Template(label, split_words(f"SPDX-License-Identifier: {name}"), False) for name, label in identifiers.items()]
    if any(t.grams < 1 for t in found):
        raise ValueError(f"a template needs {GRAM} words at least")
    return found


def gram_hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def template_grams(spark: SparkSession, found: list[Template]) -> DataFrame:
    """One row per k-gram of a template: template, its place q there, its words and their hash; and the row EVERY."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, t.words)).alias("w")) for i, t in enumerate(found)])
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.w")
    placed = listed.select("template", "w", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)).alias("q"))
    grams = placed.select("template", "q", F.slice("w", F.col("q") + 1, GRAM).alias("gram")).withColumn(
        "h", gram_hash([F.get("gram", F.lit(i)) for i in range(GRAM)]))
    every = spark.range(1).select(
        F.lit(EVERY).alias("template"), F.lit(0).alias("q"), F.array().cast("array<string>").alias("gram"),
        F.lit(0).cast("long").alias("h"))
    return grams.unionByName(every)


def votes(docs: DataFrame, found: list[Template], key: str, text: str) -> DataFrame:
    """One row per verified match (doc, n_words, template, diagonal, q), and one with template EVERY per document.

    The hashes are made in the row, exploded and probed against the broadcast templates within one stage. The words are only
    referred to until a match is found, so what is shuffled afterwards are matches.
    """
    grams = F.transform(
        F.slice(F.col("w"), 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0))),
        lambda x, i: gram_hash([x] + [F.get(F.col("w"), i + j) for j in range(1, GRAM)]),
    )
    rows = docs.select(
        F.col(key).alias("doc"), F.xxhash64(whole(text)).alias("version"), words(ascii_lower(whole(text)), BETWEEN).alias("w"))
    hashed = rows.withColumn("hs", F.array_append(grams, F.lit(0).cast("long")))
    spread = hashed.select("doc", "version", "w", F.posexplode_outer("hs").alias("p", "h"))  # outer: else a filter makes hs twice
    known = F.broadcast(template_grams(docs.sparkSession, found))  # bounded: the words of all templates
    here = F.slice("w", F.col("p") + 1, GRAM)
    hits = spread.join(known, "h").where((F.col("template") == EVERY) | (here == F.col("gram")))
    return hits.select(
        "doc", "version", F.size("w").cast("long").alias("n_words"), "template",
        F.when(F.col("template") >= 0, F.col("p") - F.col("q")).alias("diagonal"), "p", "q")


def constants(values: list) -> Column:
    return F.array(*map(F.lit, values))


def parts(lines: Column, long: Column, size: Column, least: float) -> Column:
    """Spans (n, first, last) of under ``long`` words within a run, from its diagonals with the template places seen on them.

    The run's matches pass in order of place through a window of that length. A window with enough distinct places is a
    span; of spans that overlap, the one with the most is kept, the first of equals.
    """
    matches = F.array_sort(F.flatten(F.transform(lines, lambda x: F.transform(
        x["seen"], lambda q: F.struct((x["diagonal"] + q).alias("p"), q.alias("q"))))))
    start = F.struct(
        F.array().cast("array<struct<p:int,q:int>>").alias("window"),
        F.array().cast("array<struct<n:int,first:int,last:int>>").alias("found"))

    def step(state: Column, m: Column) -> Column:
        window = F.array_append(F.filter(state["window"], lambda w: w["p"] > m["p"] - long), m)
        return let(window, lambda w: let(F.size(F.array_distinct(F.transform(w, lambda x: x["q"]))), lambda n: F.struct(
            w.alias("window"), keep(state["found"], F.struct(n.alias("n"), w[0]["p"].alias("first"), m["p"].alias("last"))).alias("found"))))

    def keep(found: Column, new: Column) -> Column:
        kept = F.try_element_at(found, F.lit(-1))
        return F.when(new["n"] / size < least, found).when(
            kept.isNull() | (new["first"] > kept["last"]), F.array_append(found, new)).when(
            new["n"] > kept["n"], F.array_append(F.slice(found, 1, F.size(found) - 1), new)).otherwise(found)

    return F.aggregate(matches, start, step, lambda s: s["found"])


def spans(found_votes: DataFrame, found: list[Template], drift: int = 6, least: float = 0.6) -> DataFrame:
    """Verified spans: doc, version, template, label, exact, first and last word, score (share of the template's k-grams).

    Exact templates need all k-grams on one diagonal. For the others, diagonals no more than ``drift`` apart are one span;
    distinct k-grams of the template are counted over the span, at least ``least`` of them must be there, and the span must
    not be longer than the template by more than the words that the drift allows. Where diagonals chain to a longer run, the
    run is cut into spans of that length at most (``parts``).
    """
    size = constants([t.grams for t in found])[F.col("template")]
    exact = constants([t.exact for t in found])[F.col("template")]
    label = constants([t.label for t in found])[F.col("template")]
    by = ["doc", "version", "template"]
    lines = found_votes.where(F.col("template") >= 0).groupBy(*by, "diagonal").agg(
        F.collect_set("q").alias("seen"), F.min("p").alias("first"), F.max("p").alias("last"))
    # a diagonal of an exact template stands alone
    w = Window.partitionBy(*by).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    opens = F.when(step.isNull() | exact | (step > drift), 1).otherwise(0)
    runs = lines.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    merged = runs.groupBy(*by, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_list(F.struct("diagonal", "seen")).alias("lines"))
    long = size + 2 * drift
    enough = merged.where(F.when(exact, F.col("n") == size).otherwise(F.col("n") / size >= least))
    split = F.when(exact | (F.col("last") - F.col("first") < long), F.array(F.struct("n", "first", "last"))).otherwise(
        parts(F.col("lines"), long, size, least))
    judged = enough.select(*by, F.explode(split).alias("part")).select(*by, "part.*").withColumn("score", F.col("n") / size)
    return judged.select("doc", "version", "template", label.alias("label"), exact.alias("exact"),
                         "first", (F.col("last") + GRAM - 1).alias("last"), "score")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
         notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words and ``spans``, an array of (label, exact, first, last, score) by place."""
    found = templates(phrases, notices)
    all_votes = votes(docs, found, key, text)
    by = ["doc", "version"]
    placed = spans(all_votes, found).select(
        *by, F.lit(None).cast("long").alias("n_words"),
        F.struct("first", "last", "label", "exact", "score").alias("span"))
    there = all_votes.where(F.col("template") == EVERY).select(
        *by, "n_words", F.lit(None).cast(placed.schema["span"].dataType).alias("span"))
    # rows that repeat id and text were found once and are given back as often as they came
    return there.unionByName(placed).groupBy(*by).agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_list("span")).alias("spans"), F.count("n_words").alias("times"),
    ).select(F.col("doc").alias("doc_id"), "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("col")

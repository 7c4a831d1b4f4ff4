"""Licence scan by diagonal voting: word k-grams are joined with template positions and vote for their offset."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases of the base rule with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices as their public licences word them, with labels of this scan.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "cc",
    "mozilla public license": "mpl",
}
#: Public licence texts and headers, with their labels.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-2-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
SHIFT = 2  # neighbouring diagonals: so many words may be missing or added between two votes
LEAST = 0.85  # share of a template's k-grams that a verified span has
_WIDTH = 62  # votes of a diagonal are bits of its template's places, so many a row
_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def places(texts: dict[str, str] | None = None) -> list[tuple]:
    """Per k-gram of a template: tid, label, base, place, grams, its words. Pairs of words of phrases and notices, triples of texts."""
    listed = [*((t, x, True, 2) for t, x in PHRASES.items()), *((t, x, False, 2) for t, x in NOTICES.items()), *((t, x, False, 3) for x, t in (TEXTS | (texts or {})).items())]
    rows = []
    for tid, (text, label, base, k) in enumerate(listed):
        words = _WORDS.findall(text.lower())
        rows += [(tid, label, base, i, len(words) - k + 1, *words[i : i + k], *[None] * (3 - k)) for i in range(len(words) - k + 1)]
    return rows


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """A row per k-gram of a template: gram, tid, label, base, place, grams."""
    table = spark.createDataFrame(places(texts), "tid int, label string, base boolean, place int, grams int, one string, two string, three string")
    gram = F.when(F.col("three").isNull(), F.xxhash64("one", "two")).otherwise(F.xxhash64("one", "two", "three"))
    return table.select(gram.alias("gram"), "tid", "label", "base", "place", "grams")


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, base places (starts, sorted), base_labels, labels, score.

    Words are runs of ASCII letters and digits (A-Z lowered) and of everything beyond ASCII. Every pair and triple of
    words of every text is joined with the templates; votes are gathered per text, template and diagonal (place in the
    text less place in the template), as bits, so repeated rows do not add up. A phrase needs all its votes on one
    diagonal; neighbouring diagonals of notices and licence texts are merged, and a merged span is verified: its words
    hold LEAST of the template's k-grams, and its diagonals spread no further than the template is long. So a licence
    with some words changed, added or left out is found, at a score below 1. score is the largest share of a label
    found, 0 without one. Null or empty text: no words, no label. Repeated rows are each returned, a null doc_id stays
    null; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    upper, lower = (",".join(chr(c) for c in range(a, a + 26)).replace(",", "") for a in (65, 97))
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, lower)
    rows = docs.select("doc_id", F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+").alias("w"))
    first, last = (F.get("w", F.lit(0)) == "").cast("int"), F.when((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "w", first.alias("skip"), (F.size("w") - first - last).alias("n"))
    pairs = F.transform(F.expr("sequence(skip, skip + n - 2)"), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    triples = F.transform(F.expr("sequence(skip, skip + n - 3)"), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    own, start = F.xxhash64(F.array_join("w", " ")), F.array(F.lit(0).cast("long"))
    listed = F.when(F.col("n") >= 3, F.concat(start, pairs, triples)).when(F.col("n") == 2, F.concat(start, pairs)).otherwise(start)
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_words"), own.alias("own"), listed.alias("grams"))
    each = rows.select("doc_id", "own", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    table = F.broadcast(templates(docs.sparkSession, texts))  # a row a word of the templates
    votes = each.join(table, (each["gram"] == table["gram"]) & (each["at"] > 0), "left").filter("at = 0 or tid is not null")
    key = ["doc_id", "own", "n_words"]
    place = F.when(F.col("at") < F.col("n_words"), F.col("at") - 1).otherwise(F.col("at") - F.col("n_words")).cast("int")
    votes = votes.select(*key, "tid", "label", "base", "grams", (place - F.col("place")).alias("diagonal"), F.floor(F.col("place") / _WIDTH).cast("int").alias("cell"), F.expr(f"shiftleft(1L, place % {_WIDTH})").alias("bits"))
    lines = votes.groupBy(*key, "tid", "label", "base", "grams", "diagonal", "cell").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("k"))

    w = Window.partitionBy(*key, "tid").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("base"), 0).otherwise(SHIFT), F.lit(True)).cast("int")
    cells = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy(*key, "tid", "label", "base", "grams", "run", "cell").agg(F.bit_or("bits").alias("bits"), F.min("diagonal").alias("start"), F.max("diagonal").alias("most"), F.sum("k").alias("k"))
    merged = cells.groupBy(*key, "tid", "label", "base", "grams", "run").agg(F.sum(F.bit_count("bits")).alias("votes"), F.min("start").alias("start"), F.max("most").alias("most"), F.sum("k").alias("k"))
    share = F.col("votes") / F.col("grams")
    sound = F.when(F.col("base"), share == 1).otherwise((share >= LEAST) & (F.col("most") - F.col("start") <= F.col("grams")))
    spans = merged.select(*key, "label", "base", "k", F.col("start").cast("long").alias("start"), F.when(sound, share).alias("share"), F.col("tid").isNull().alias("row"))
    found = spans.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("base") & F.col("share").isNotNull(), F.col("start")))).alias("places"),
        F.array_sort(F.collect_set(F.when(F.col("base") & F.col("share").isNotNull(), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label")))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.sum(F.when(F.col("row"), F.col("k"))).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("own", "copies", "copy")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places", F.lit(0)).alias("first_word"), F.get("places", F.size("places") - 1).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")

"""Licence scans: lines and runs of words against licence templates by the Dice coefficient of word bigrams.

Everything runs as DataFrame expressions. Texts without any of the templates' rare bigrams, one of
which every match holds, are dropped first; in the others the rare bigrams place the runs to score.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.llm.common import cut, local
from terrafoot.llm.license_texts import TEXTS

#: Short notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: What texts are held against unless templates are given.
NOTICES = TEMPLATES | TEXTS

#: Words of a text that are worked on together.
CHUNK_WORDS = 1024

#: A line or run matches a template from this Dice coefficient on, in hundredths.
LEAST_DICE = 85


def _words(line: Column) -> Column:
    """Normalised words: lower case, letters and digits, with inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def _bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def anchors(words: list[str], bigrams: list[str], least: int) -> list[tuple[str, int]]:
    """(bigram, place) of so many of a template's rarest bigrams that no match can lack them all.

    A match shares at least least / (200 - least) of the template's bigrams. Bigrams whose shorter word
    is long count as rare.
    """
    spare = len(bigrams) - -(-len(bigrams) * least // (200 - least))
    chosen = set(sorted(bigrams, key=lambda b: (-min(map(len, b.split(" "))), -len(b), b))[: spare + 1])
    places = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))]
    return [(b, i) for i, b in enumerate(places) if b in chosen]


def _chunks(lines: DataFrame, longest: int) -> DataFrame:
    """Texts in chunks of CHUNK_WORDS words, each with ``longest`` words of both neighbours: row, doc_id, chunk, base (its first word's number), numbered (word, line).

    A place's run lies within the place's own chunk, so no row holds more than a chunk from here on.
    """
    first, n, size = F.col("first"), F.size("words"), F.lit(CHUNK_WORDS)
    low = lambda c: F.greatest(first, c * size - longest)
    high = lambda c: F.least(first + n, (c + 1) * size + longest)
    cut_up = F.transform(F.sequence(F.greatest(F.lit(0), F.floor((first - longest) / size) - 1).cast("int"), F.floor((first + n - 1 + longest) / size).cast("int")), lambda c: F.struct(c.alias("chunk"), low(c).alias("start"), F.slice("words", low(c) - first + 1, F.greatest(F.lit(0), high(c) - low(c))).alias("words")))
    parts = lines.select("row", "doc_id", "line", F.explode(cut_up).alias("part")).where(F.size("part.words") > 0)
    chunks = parts.groupBy("row", "doc_id", F.col("part.chunk").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("part.start", "line", "part.words"))).alias("parts"))
    numbered = F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: F.struct(w.alias("word"), p["line"].alias("line")))))
    return chunks.select("row", "doc_id", "chunk", F.col("parts")[0]["start"].alias("base"), numbered.alias("numbered"))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DICE, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match: row, doc_id, line (from 1, where it starts), license, dice.

    Lines, and runs of words across lines of each template's length that share a rare bigram with the
    template at its place, are scored by dice = 2 * common / (bigrams + template bigrams). Of
    overlapping matches the best stays: by dice, then length, then name. Null and empty texts match
    nothing; texts of any length are read whole, cut into chunks of words that overlap. Rows that share
    an id are scanned one by one; an empty table gives no rows. Matches that overlap in a chain are
    thinned out in one value, some hundred bytes a match.
    """
    spark = docs.sparkSession
    text = lambda *names: pa.schema({n: pa.string() for n in names})
    fixed = local(spark, text("license", "template"), list((NOTICES if templates is None else templates).items()))
    fixed = fixed.withColumn("words", _words(F.col("template"))).select("license", "words", _bigrams(F.col("words")).alias("bigrams")).where(F.size("words") > 0).collect()  # of the fixed templates
    places = [(b, r.license, i) for r in fixed for b, i in anchors(r.words, r.bigrams, least)]
    rare_at = local(spark, text("bigram", "license").append(pa.field("place", pa.int32())), places)
    small = local(spark, pa.schema({"license": pa.string(), "length": pa.int32(), "wanted": pa.list_(pa.string())}), [(r.license, len(r.words), r.bigrams) for r in fixed])
    rare = sorted({b for b, _, _ in places})
    neighbours = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(w)
    single = [b for b in rare if " " not in b]  # templates of one word, which any place may hold
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    telling = sorted({max(b.split(" "), key=lambda w: (len(w), w)) for b in rare})  # one word of each rare bigram
    holds = lambda w: F.exists(w, lambda x: x.isin(telling)) & F.exists(neighbours(w), lambda b: b.isin(rare)) | (F.exists(w, lambda x: x.isin(single)) if single else F.lit(False))
    maybe = rows.where(F.exists(F.array(_words(F.col("text"))), holds))  # the one-element array has the words found once
    maybe = cut(maybe.select("row", "doc_id", "text"), "license-texts")

    lines = maybe.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumn("words", _words(F.col("text")))
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("row", "doc_id", (F.col("pos") + 1).alias("line"), "words", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).cast("int").alias("first"))
    lines = cut(lines, "license-lines")
    whole = lines.withColumn("bigram", F.explode(F.array_distinct(F.concat(neighbours(F.col("words")), F.col("words") if single else F.array())))).where(F.col("bigram").isin(rare))
    whole = whole.join(F.broadcast(rare_at.select("bigram", "license").distinct()), "bigram").dropDuplicates(["row", "line", "license"]).select("row", "doc_id", "line", "license", "first", "words")

    longest = max((len(r.words) for r in fixed), default=1)
    texts = _chunks(lines.where(F.size("words") > 0), longest).withColumn("words", F.col("numbered.word"))
    own = lambda x: (x["at"] >= F.col("chunk") * CHUNK_WORDS) & (x["at"] < (F.col("chunk") + 1) * CHUNK_WORDS)
    spots = F.transform(neighbours(F.col("words")), lambda b, i: F.struct(b.alias("bigram"), (F.col("base") + i).alias("at")))
    spots = F.concat(spots, F.transform("words", lambda w, i: F.struct(w.alias("bigram"), (F.col("base") + i).alias("at")))) if single else spots
    start = lambda at: F.greatest(F.lit(0), at - longest)
    near = F.transform(F.filter(spots, lambda x: x["bigram"].isin(rare) & own(x)), lambda x: F.struct(x["bigram"].alias("bigram"), x["at"].alias("at"), F.slice("numbered", start(x["at"]) - F.col("base") + 1, F.lit(2 * longest)).alias("numbered")))
    hits = texts.select("row", "doc_id", F.explode(near).alias("spot")).select("row", "doc_id", "spot.*")
    runs = hits.join(F.broadcast(rare_at), "bigram").join(F.broadcast(small.select("license", "length")), "license")
    runs = runs.withColumn("first", F.greatest(F.lit(0), F.col("at") - F.col("place")))
    run = F.slice("numbered", F.col("first") - start(F.col("at")) + 1, F.col("length"))
    runs = runs.select("row", "doc_id", "license", "first", run.alias("run")).select("row", "doc_id", F.col("run")[0]["line"].alias("line"), "license", "first", F.col("run.word").alias("words"))
    runs = runs.dropDuplicates(["row", "license", "first"])

    scored = whole.unionByName(runs).withColumn("bigrams", _bigrams(F.col("words"))).join(F.broadcast(small), "license")
    scored = scored.withColumns({"n": F.size("bigrams"), "template_size": F.size("wanted"), "last": F.col("first") + F.size("words")})
    bound = (F.col("n") * (200 - least) >= F.col("template_size") * least) & (F.col("template_size") * (200 - least) >= F.col("n") * least)
    common = scored.where(bound).withColumn("common", F.size(F.array_intersect("bigrams", "wanted"))).where(200 * F.col("common") >= least * (F.col("n") + F.col("template_size")))
    found = common.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("template_size"))).select("row", "doc_id", "line", "license", "dice", "first", "last").distinct()

    order = Window.partitionBy("row").orderBy("first", "last")
    heads = found.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.withColumn("group", F.sum(F.when(F.col("first") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    match = F.struct((-F.col("dice")).alias("minus"), (F.col("first") - F.col("last")).alias("size"), "license", "first", "last", "line")
    groups = heads.groupBy("row", "doc_id", "group").agg(F.array_sort(F.collect_list(match)).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda a, x: F.when(F.exists(a, lambda y: (y["first"] < x["last"]) & (x["first"] < y["last"])), a).otherwise(F.concat(a, F.array(x))))
    best = groups.select("row", "doc_id", F.explode(kept).alias("m"))
    return best.select("row", "doc_id", F.col("m.line").alias("line"), F.col("m.license").alias("license"), (-F.col("m.minus")).alias("dice"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DICE, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with a match: doc_id, n_matches, licenses (sorted), best_dice; none for an empty table."""
    found = license_matches(docs, id_col, text_col, least, templates)
    grouped = found.groupBy("row", "doc_id").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_set("license")).alias("licenses"), F.round(F.max("dice"), 6).alias("best_dice"))
    return grouped.drop("row")

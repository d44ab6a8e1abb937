"""License scans by diagonal voting, in DataFrame functions only.

Hashes of all three-word windows of the texts are matched with the windows of the license templates, a short fixed list.
A hit at word p of the text and word q of a template votes for the diagonal p - q. Neighbouring diagonals (the text may
have gained or lost some words) are one cluster, whose hits that lie close together are merged into a span.

A span is verified word by word: the edit distance of its words, in order, to the template's, as a share of the
template's, leaves at least ``coverage`` (a template of fewer than SHORT words must stand as it is), and the words that
tell a template from its relatives must be there. Where verified spans overlap, the one that covers more words wins, then
the better covered one, so a notice has one label. Base phrases are found apart and keep their labels.

Defined cases: a null text is the empty text; rows of one id with different texts are told apart by their text's hash,
repeated rows get equal rows; a null id is kept; an empty table gives an empty result; further columns are ignored. Words are
compared by a 16-bit code of each; the telling words by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
GRAM = 3
MAX_DRIFT = 6
MAX_GAP = 40
COVERAGE = 0.6
SHORT = 10
SPANS = "array<struct<score:double,size:int,label:string,first:int,last:int>>"

# The base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public notices, as their words.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = (
    " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free "
    "software foundation either version {} of the license or at your option any later version this {} is distributed in the hope that it will be "
    "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
)
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
    "you can obtain one at"
)

# Notices of public licenses, as (label, text, the words that tell it from its relatives).
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", _MIT, "sublicense"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache", _APACHE, "apache"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ""),
    ("gpl", "licensed under the gnu general public license version", ""),
    ("gpl", "under the terms of the gnu general public license", ""),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("gpl-2", "this program " + _GNU.format("", "2", "program"), "gnu 2"),
    ("gpl-3", "this program " + _GNU.format("", "3", "program"), "gnu 3"),
    ("lgpl", "this library " + _GNU.format("lesser ", "2 1", "library"), "lesser"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser"),
    ("agpl", "this program " + _GNU.format("affero ", "3", "program"), "affero"),
    ("agpl", "under the terms of the gnu affero general public license", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("bsd-2-clause", _BSD, "reproduce"),
    ("bsd-3-clause", _BSD + _BSD_THIRD, "endorse"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("cc-by", "licensed under cc by 4 0", "by"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "nc sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived"),
    ("mpl", _MPL, "mozilla"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    ("isc", _ISC, "fee"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "reserved"),
)


def scan_words(text: Column) -> Column:
    """The words of a text after lower-casing A-Z."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), 1)


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of this size; none if there are fewer words."""
    n = F.size(words) - size + 1
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    )


def coded(words: Column) -> Column:
    """A string with a character for each word."""
    # four hexadecimal digits from 1000 to AFFF, of which none is half of a pair
    digits = F.transform(words, lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(0xA000)) + 0x1000))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-16BE")


def _template_rows(spark, templates) -> DataFrame:
    """``(template, label, size, code, must, grams)`` of the fixed templates."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, label string, text string, must string")
    words = scan_words(F.col("text"))
    return rows.select("template", "label", F.size(words).alias("size"), coded(words).alias("code"), scan_words(F.col("must")).alias("must"), _windows(words, GRAM).alias("grams"))


def _phrase_places(words: Column, phrases) -> Column:
    """``array<struct<label, at>>``: places where all words of a base phrase stand consecutively."""
    parts = []
    for phrase, label in phrases:
        first, *others = phrase.split()

        def here(w: Column, i: Column) -> Column:
            fits = w == first
            for k, other in enumerate(others, 1):
                fits = fits & F.get(words, i + k).eqNullSafe(F.lit(other))
            return F.when(fits, i)

        places = F.array_compact(F.transform(words, here))
        parts.append(F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at"))))
    return F.concat(*parts)


def votes(seen: DataFrame, table: DataFrame) -> DataFrame:
    """``seen(doc_id, text_key, hits)`` joined with the templates' windows, counted by diagonal.

    A long text's hits on one diagonal are kept apart every MAX_GAP words; :func:`spans` joins what belongs together.
    """
    windows = table.select("template", F.posexplode("grams").alias("at", "gram"))
    grams = seen.select("doc_id", "text_key", F.explode("hits").alias("h")).select("doc_id", "text_key", "h.*")
    hits = grams.join(F.broadcast(windows), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    part = F.floor(F.col("pos") / MAX_GAP).alias("part")
    return hits.groupBy("doc_id", "text_key", "template", "diagonal", part).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")
    )


def spans(found: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: ``(doc_id, text_key, template, first, last, low, high, n)``."""
    keys = ("doc_id", "text_key", "template")
    along = Window.partitionBy(*keys).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MAX_DRIFT, F.lit(False))
    # a stray hit on a far diagonal is a cluster of its own and parts no other
    rows = found.withColumn("far", far.cast("int")).withColumn("cluster", F.sum("far").over(along))
    order = Window.partitionBy(*keys, "cluster").orderBy("first", "diagonal")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("first") - before > MAX_GAP, F.lit(False)).cast("int"))
    rows = rows.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "cluster", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    ).drop("cluster", "span")


def verified(found: DataFrame, texts: DataFrame, table: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Spans whose words are the template's: ``(doc_id, text_key, spans)`` with (label, first, last, score), overlaps decided.

    A span begins where the template would begin before its first hit, and ends likewise.
    """
    known = F.broadcast(table.select("template", "label", "size", "code", "must"))
    rows = found.join(known, "template")
    # an edited word breaks as many windows as it stands in, so spans of too few hits cannot reach the coverage
    least = F.when(F.col("size") < SHORT, F.col("size") - GRAM + 1).otherwise(F.greatest(F.lit(1), F.col("size") - GRAM + 1 - GRAM * F.floor((1 - coverage) * F.col("size"))))
    rows = rows.where(F.col("n") >= least)
    rows = rows.select("doc_id", "text_key", F.struct(
        (F.col("last") + GRAM - 1 + F.col("size") - GRAM - F.col("high")).alias("to"), F.greatest(F.col("first") - F.col("low"), F.lit(0)).alias("from"), "label", "size", "code", "must"
    ).alias("c"))
    listed = rows.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("c").alias("cs"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    words = texts.select("doc_id", "text_key", "words").join(listed, same)  # repeated rows each have theirs

    def check(c: Column) -> Column:
        part = F.slice("words", c["from"] + 1, c["to"] - c["from"] + 1)
        gone = F.call_function("levenshtein", coded(part), c["code"])
        score = F.when(F.size(F.array_except(c["must"], part)) == 0, F.greatest(1 - gone / c["size"], F.lit(0.0))).otherwise(0.0)
        return F.struct(score.alias("score"), c["size"].alias("size"), c["label"].alias("label"), c["from"].alias("first"), F.least(c["to"], F.size("words") - 1).alias("last"))

    enough = lambda x: x["score"] >= F.when(x["size"] < SHORT, 1.0 - 1e-9).otherwise(coverage)
    rows = words.select("doc_id", "text_key", F.transform("cs", check).alias("all")).select("doc_id", "text_key", F.filter("all", enough).alias("all"))
    order = lambda x: F.struct((x["score"] * x["size"]).alias("a"), x["score"].alias("b"), x["label"].alias("c"))
    meets = lambda x, y: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & (order(y) > order(x))
    best = F.filter("all", lambda x: ~F.exists("all", lambda y: meets(x, y)))
    return rows.select("doc_id", "text_key", best.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """One row per row of docs: word count, base phrase places, labels, score (the best span; 1 for a base phrase), spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = rows.select("doc_id", F.xxhash64("text").alias("text_key"), scan_words(F.col("text")).alias("words"))
    scratch = Scratch(docs.sparkSession, "licenses")
    table = scratch.save(_template_rows(docs.sparkSession, templates), "templates")
    known = [r.gram for r in table.select(F.explode("grams").alias("gram")).distinct().orderBy("gram").collect()]  # of the fixed templates
    full = words.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), _phrase_places(F.col("words"), phrases).alias("base"),
        _windows(F.col("words"), GRAM).alias("grams"), "words",
    )
    # only known windows are kept, and only the texts that have some are kept whole
    at = F.array_compact(F.transform("grams", lambda g, i: F.when(g.isin(known), i)))
    hits = full.withColumn("at", F.coalesce(at, F.array().cast("array<int>")))
    found = F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("grams", i).alias("gram")))
    hits = hits.select("doc_id", "text_key", "n_words", "base", found.alias("hits"), F.when(F.size("at") > 0, F.col("words")).alias("words"))
    summary = scratch.save(hits, "summary")
    seen = summary.where(F.size("hits") > 0)
    once = seen.select("doc_id", "text_key", "hits").dropDuplicates(["doc_id", "text_key"])  # equal rows vote once
    labelled = verified(spans(votes(once, table)), seen, table, coverage)
    labelled = labelled.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    joined = summary.drop("hits", "words").join(labelled, same, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    n_base, places = F.size("base"), F.transform("base", lambda b: b["at"])
    base_labels = F.transform("base", lambda b: b["label"])
    every = F.concat(base_labels, F.transform("spans", lambda x: x["label"]))
    text = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        text(base_labels).alias("base_labels"), text(every).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))).alias("score"), "spans",
    )

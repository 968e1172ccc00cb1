"""License scans by diagonal voting (operator 1).

Every text is cut into words and rolling hashes of ``k`` consecutive words (k = 3, and 2 for the
templates of two words). Each hash joins the template positions with the same hash; a match whose
words are equal too is a vote of that position for the diagonal (text position minus template
position). Votes are gathered by (text, template, diagonal); neighbouring diagonals, as left by an
inserted or missing word, are merged where the template allows a drift; a span is verified by its
positions: it needs the template's share of the template's k-grams, each counted once however often
it votes. A chain of diagonals wider than the template is looked at in windows of twice its length, one
length apart, so that a notice inside a chain is found and votes far from each other don't add up.

Base phrases are templates without drift that need all of their positions, so a span is a place where
the words stand consecutively. One more template, of one reserved hash, makes every text vote once:
texts without a license keep their row without a second pass over the table.

Templates are given in code, or as a table (label, text, need, drift, base) of any size: its k-grams are
broadcast if they are counted to be few, else the k-grams of all texts meet them in a shuffle. Their
words are compared, too. Only votes are shuffled beyond that, by text, so no phrase, however common, is
a hot key there.

Defined cases: NULL and empty texts have no words, places or labels (empty strings, score 0); NULL
ids stay; repeated rows are rows of their own (rows are told apart by the scan's row number within
this one pass); no rows, no result; extra columns are ignored. Texts of any length: a text's hashes
are one array of 8 bytes a word. Templates of under two words are left out, equal ones count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickweave.llm.common import ascii_lower, bounded, text_or_empty, words_of

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    need: float = 0.7
    drift: int = 3
    base: bool = False


#: Base phrases and their labels.
BASE = (Template("cc-by", "cc by", 1.0, 0, True),
        Template("gpl", "general public license", 1.0, 0, True),
        Template("reserved", "all rights reserved", 1.0, 0, True))
#: Usual notices of public licenses.
NOTICES = (
    Template("mit", "released under the mit license", 1.0, 0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                    "and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0", 1.0, 0),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of "
                           "the license at http www apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 1.0, 0),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license as published by the free software foundation"),
    Template("cc-by-nc", "licensed under cc by nc", 1.0, 0),
    Template("cc-by-sa", "licensed under cc by sa", 1.0, 0),
    Template("cc-by-nd", "licensed under cc by nd", 1.0, 0),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
_EVERY_TEXT = -1


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k words at 0, 1, ...; k is 2 or 3."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(F.lit(k), w, *[words[i + j] for j in range(1, k)]))


def template_table(spark: SparkSession, templates: tuple[Template, ...] | DataFrame) -> DataFrame:
    """template (a number), label, base, need, drift, words."""
    if isinstance(templates, DataFrame):
        words = words_of(ascii_lower(text_or_empty()), LICENSE_WORD)
        table = templates.select("label", F.coalesce("base", F.lit(False)).alias("base"), F.col("need").cast("double").alias("need"),
                                 F.col("drift").cast("int").alias("drift"), words.alias("words")).where("size(words) > 1")
        number = F.shiftrightunsigned(F.xxhash64("label", F.concat_ws(" ", "words")), 1)
        return table.withColumn("template", number).dropDuplicates(["template"])
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(t).cast("long").alias("template"), F.lit(x.label).alias("label"), F.lit(x.base).alias("base"), F.lit(float(x.need)).alias("need"),
                 F.lit(x.drift).alias("drift"), F.array(*map(F.lit, x.text.split(" "))).alias("words")) for t, x in enumerate(templates)])))


def template_grams(table: DataFrame) -> DataFrame:
    """One row per template position: hash, template, at, k and the k-gram's words; and the reserved one."""
    k = F.least(F.lit(3), F.size("words"))
    grams = table.select("template", "words", k.alias("k"), F.posexplode(F.when(k == 2, _grams(F.col("words"), 2)).otherwise(_grams(F.col("words"), 3))).alias("at", "hash"))
    every = table.sparkSession.range(1).select(F.lit(_EVERY_TEXT).cast("long").alias("hash"), F.lit(_EVERY_TEXT).cast("long").alias("template"),
                                               F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("array<string>").alias("gram"))
    return grams.select("hash", "template", "at", "k", F.slice("words", F.col("at") + 1, F.col("k")).alias("gram")).unionByName(every)


def license_votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, template, diagonal): the positions that voted, first and end (words of the text)."""
    words = F.col("words")
    grams = F.concat(F.array(F.lit(_EVERY_TEXT).cast("long")), _grams(words, 2), _grams(words, 3))
    texts = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
                         words_of(ascii_lower(text_or_empty()), LICENSE_WORD).alias("words"))
             .withColumn("n", F.size("words")).withColumn("grams", grams))
    at = (texts.select("rid", "doc_id", "n", "words", F.posexplode("grams").alias("p", "hash")))
    # places of the arrays joined in ``grams``: 1 reserved, n - 1 pairs (none without a word), then triples
    pairs = F.greatest(F.col("n") - 1, F.lit(0))
    place = F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == 2, F.col("p") - 1).otherwise(F.col("p") - 1 - pairs)
    same = (F.col("k") == 0) | (F.slice(F.col("words"), F.greatest(place + 1, F.lit(1)), F.greatest(F.col("k"), F.lit(1))) == F.col("gram"))
    votes = at.join(bounded(template_grams(table)), "hash").where(same)
    # a diagonal has each position once at most
    return (votes.select("rid", "doc_id", "n", "template", (place - F.col("at")).alias("diagonal"), place.alias("place"),
                         (place + F.col("k")).alias("past"), "at")
            .groupBy("rid", "doc_id", "n", "template", "diagonal")
            .agg(F.collect_list("at").alias("positions"), F.min("place").alias("first"), F.max("past").alias("end")))


def license_spans(votes: DataFrame, table: DataFrame) -> DataFrame:
    """Votes of neighbouring diagonals merged: rid, doc_id, n, template, label, base, first, end,
    coverage (0 to 1); plus one row per text with a NULL template."""
    length = F.size("words")
    facts = table.select("template", "label", "base", "drift", "need", F.greatest(F.lit(1), length - 2).alias("grams"), length.alias("length"))
    v = votes.join(bounded(facts), "template", "left")
    of = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(of) > F.coalesce("drift", F.lit(0))
    v = v.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(of))
    chain = Window.partitionBy("rid", "template", "span")
    v = v.withColumns({"lo": F.min("diagonal").over(chain), "hi": F.max("diagonal").over(chain)})
    step = F.floor((F.col("diagonal") - F.col("lo")) / F.col("length"))
    wide = F.col("hi") - F.col("lo") > F.col("length")
    v = v.withColumn("part", F.explode(F.when(wide, F.array(step, step - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    spans = v.groupBy("rid", "doc_id", "n", "template", "label", "base", "need", "grams", "span", "part").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"), F.min("first").alias("first"), F.max("end").alias("end"))
    coverage = F.col("positions") / F.col("grams")
    verified = (F.col("template") < 0) | (coverage >= F.col("need"))
    return spans.where(verified).select("rid", "doc_id", "n", F.when(F.col("template") >= 0, F.col("template")).alias("template"),
                                        "label", "base", "first", "end", coverage.alias("coverage"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] | DataFrame = BASE + NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best coverage of a span)."""
    table = template_table(docs.sparkSession, templates)
    spans = license_spans(license_votes(docs, table), table)
    base = F.col("base")

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    return spans.groupBy("rid", "doc_id", "n").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")

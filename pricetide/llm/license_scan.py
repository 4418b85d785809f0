"""Licence paragraphs: a trained classifier, confirmed by comparison with templates.

Everything runs on Spark's own functions and its library's feature and regression stages.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.session import observed_counts, stage

NONE = "none"
FEATURES = 1 << 14
# Paragraphs of the corpus that teach what is no licence, at most.
NEGATIVES = 4000
# Confirmed if a template has at least this share of its word triples in the paragraph.
TEMPLATE_SHARE = 0.8
# A licence is believed from the score that at most this share of all paragraphs of no
# family, in documents not trained on, goes above, and that makes it likelier than none.
FALSE_RATE = 0.001
LIKELIER = 0.5
# Below this score nothing is compared with the templates.
LEAST_SCORE = 0.05
# Words scored together, and from one start to the next: any run of as many words as the
# longest template is whole in one of them.
WINDOW = 96
STEP = 64
UNKNOWN = "unknown"
TRIPLE = 3

# The usual wording of licence notices by family.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "Released under the GNU General Public License, version 2."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Licensed under the BSD 2-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Released under the ISC License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: Column) -> Column:
    """Lower-case ASCII letters and digits between all other characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda word: word != "")


def triples(words: Column) -> Column:
    """Distinct runs of three words; all words, if there are fewer."""
    last = F.greatest(F.size(words) - TRIPLE + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda at: F.concat_ws(" ", F.slice(words, at, TRIPLE)))
    return F.array_distinct(runs)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``family``, ``label`` and the word triples of every template."""
    families = sorted({family for family, _ in templates})
    rows = [(f, families.index(f) + 1, i, t) for i, (f, t) in enumerate(templates)]
    table = spark.createDataFrame(rows, "family string, label int, template int, text string")
    return table.withColumn("words", words_of(F.col("text"))).withColumn("triples", triples(F.col("words")))


def _starts(n: Column) -> Column:
    """Where windows over ``n`` words begin, from 0."""
    more = F.ceil(F.greatest(n - WINDOW, F.lit(0)) / STEP).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: k * STEP)


def paragraphs(docs: DataFrame) -> DataFrame:
    """What is scored of every document: ``words`` of its lines, and across the line ends
    of hard-wrapped paragraphs, which end at lines without words.

    Both are cut to overlapping windows. ``lines`` has the line number of each word.
    """

    def numbered(line: Column, at: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))
        return F.when(plain == "", F.lit("")).otherwise(F.concat_ws(" ", at.cast("string"), plain))

    def of_line(parts: Column) -> Column:
        number = parts[0].cast("int")
        cut = lambda start: F.slice(parts, start + 2, WINDOW)
        return F.transform(
            _starts(F.size(parts) - 1),
            lambda start: F.struct(F.array_repeat(number, F.size(cut(start))).alias("lines"), cut(start).alias("words")),
        )

    text = F.concat_ws("\n", F.transform(F.split("text", "\n"), numbered))
    blocks = docs.select("doc_id", "row", F.explode_outer(F.split(text, "\n\n+")).alias("block"))
    filled = F.filter(F.split("block", "\n"), lambda line: line != "")
    parsed = blocks.select("doc_id", "row", F.transform(filled, lambda line: F.split(line, " ")).alias("parsed"))
    number = lambda parts: F.array_repeat(parts[0].cast("int"), F.size(parts) - 1)
    several = F.when(F.size("parsed") > 1, F.col("parsed")).otherwise(F.slice("parsed", 1, 0))
    both = parsed.select(
        "doc_id",
        "row",
        "parsed",
        F.flatten(F.transform(several, number)).alias("at"),
        F.flatten(F.transform(several, lambda parts: F.slice(parts, F.lit(2), F.size(parts)))).alias("wrapped"),
    )
    windows = F.transform(
        _starts(F.size("wrapped")),
        lambda start: F.struct(F.slice("at", start + 1, WINDOW).alias("lines"), F.slice("wrapped", start + 1, WINDOW).alias("words")),
    )
    joined = F.filter(windows, lambda w: F.try_element_at(w["lines"], F.lit(1)) < F.try_element_at(w["lines"], F.lit(-1)))
    units = F.concat(F.flatten(F.transform("parsed", of_line)), joined)
    # The outer form, as the other one has Spark compute the array twice to look for empty ones.
    each = both.select("doc_id", "row", F.explode_outer(units).alias("unit")).filter("unit IS NOT NULL")
    return each.select("doc_id", "row", "unit.lines", "unit.words")


def with_features(df: DataFrame) -> DataFrame:
    """Counts of single words and of pairs, hashed into one sparse vector."""
    pairs = NGram(n=2, inputCol="words", outputCol="_pairs").transform(df)
    both = pairs.withColumn("_grams", F.concat("words", "_pairs"))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")
    return hashed.transform(both).drop("_pairs", "_grams")


def training_rows(docs: DataFrame, templates: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """``words`` and ``label``: templates as they are and amid other words, and paragraphs
    of the corpus without any template's word triple (label 0)."""
    n = docs.count()
    # So many documents, drawn by hash, one paragraph of each.
    share = min(1.0, 4.0 * negatives / max(1, n))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < int(share * 1_000_000))
    lines = F.split("text", "\n")
    pick = F.pmod(F.xxhash64("doc_id", F.lit("line")), F.size(lines)).cast("int")
    one = drawn.filter("text IS NOT NULL").select("doc_id", F.try_element_at(lines, pick + 1).alias("line"))
    sample = one.select("doc_id", F.slice(words_of(F.col("line")), 1, WINDOW).alias("words")).filter(F.size("words") > 0)
    order = Window.orderBy("order", "doc_id")
    sample = stage(
        sample.withColumn("order", F.xxhash64("doc_id", F.lit("order"))).orderBy("order", "doc_id").limit(negatives),
        "licence-negatives",
    )
    known = [row[0] for row in templates.select(F.explode("triples")).distinct().collect()]
    clean = sample.filter(~F.arrays_overlap(triples(F.col("words")), F.lit(known)))
    numbered = clean.withColumn("n", F.row_number().over(order))
    count = templates.count()
    # Each of the first paragraphs lends its words to the template of the same number.
    lent = numbered.filter(F.col("n") <= 20 * count).select(
        F.pmod("n", F.lit(count)).alias("template"), "n", "doc_id", "words", F.slice("words", 1, 8).alias("lent")
    ).withColumnRenamed("words", "around")
    half = (WINDOW - 36) // 2
    before, after = F.slice("around", 1, half), F.slice("around", half + 1, half)
    lent = lent.withColumn("round", F.floor(F.col("n") / count) % 3)
    amid = lent.join(templates.select("template", "label", "words"), "template").select(
        F.when(F.col("round") == 0, F.concat("lent", "words"))
        .when(F.col("round") == 1, F.concat("words", "lent"))
        .otherwise(F.concat(before, "words", after))
        .alias("words"),
        "label",
        F.col("n").alias("n"),
        "doc_id",
    )
    plain = templates.select("words", "label", F.lit(1).alias("n"), F.lit(None).cast("long").alias("doc_id"))
    # What templates' own first words begin with is no licence yet.
    rest = numbered.select("words", F.lit(0).alias("label"), "n", "doc_id")
    return stage(plain.unionByName(amid).unionByName(rest), "licence-training")


def train(rows: DataFrame) -> LogisticRegressionModel:
    kept = with_features(rows.filter("label > 0 OR n % 4 != 0"))
    return LogisticRegression(
        maxIter=60, regParam=1e-4, family="multinomial", featuresCol="features", labelCol="label"
    ).fit(kept)


def scored(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """The probability of any licence, and the likeliest family's label: 0 if no family
    has more than half of it."""
    out = model.transform(with_features(df)).withColumn("_p", vector_to_array("probability"))
    families = F.slice("_p", 2, F.size("_p"))
    best = F.array_max(families)
    score = 1 - F.col("_p")[0]
    likeliest = F.when(best > score / 2, F.array_position(families, best)).otherwise(0).cast("int")
    return out.withColumn("score", score).withColumn("label", likeliest).drop(
        "_p", "features", "rawPrediction", "probability", "prediction"
    )


def threshold(likely: DataFrame, templates: DataFrame, n_held: int) -> float:
    """The score that paragraphs of no family seldom reach: of all ``n_held`` paragraphs of
    documents not trained on, the least score above which lies at most ``FALSE_RATE``.

    ``likely`` has every one of them that scores ``LEAST_SCORE`` or more; of the others only
    the number matters. One that is likelier than none and has a template's word triple may
    state a licence, and is left out.
    """
    known = [row[0] for row in templates.select(F.explode("triples")).distinct().collect()]
    high = likely.filter(F.col("held") & (F.col("score") >= LIKELIER))
    cases = stage(
        high.select("score", F.arrays_overlap(triples(F.col("words")), F.lit(known)).alias("stated")), "licence-cases"
    )
    counts = cases.groupBy("stated").count().collect()
    n_stated, n = (sum(r["count"] for r in counts if r["stated"] is stated) for stated in (True, False))
    # The rank from the highest, from 0, in whole numbers of a thousandth.
    rank = (n_held - n_stated) * round(FALSE_RATE * 1000) // 1000
    if rank >= n:
        return LIKELIER
    return cases.filter("NOT stated").agg(F.expr(f"percentile_disc({(n - rank - 0.5) / n}D) WITHIN GROUP (ORDER BY score)")).first()[0]


def compared(likely: DataFrame, templates: DataFrame, believed: float) -> DataFrame:
    """A row for each family of the scored words: those that templates confirm, or else
    the likeliest one if the score is believed. ``first`` and ``last`` are its lines."""
    known = templates.select("family", "triples").collect()
    names = F.array(F.lit(UNKNOWN), *(F.lit(f) for f in sorted({r["family"] for r in known})))
    table = F.array(*(F.struct(F.lit(r["family"]).alias("family"), F.lit(r["triples"]).alias("wanted")) for r in known))

    def match(template: Column) -> Column:
        shared = F.array_intersect("own", template["wanted"])
        share = F.size(shared) / F.size(template["wanted"])
        return F.struct(share.alias("share"), F.size(shared).alias("n"), template["family"].alias("family"), shared.alias("shared"))

    own = likely.withColumn("own", triples(F.col("words")))
    every = own.withColumn("every", F.sort_array(F.transform(table, match), asc=False))
    near = every.withColumn("near", F.filter("every", lambda m: m["share"] >= TEMPLATE_SHARE))
    # A family whose shared triples all belong to better matches is only akin to those.
    sure = F.filter(
        "near",
        lambda m, i: F.size(F.array_except(m["shared"], F.flatten(F.slice("near", F.lit(1), i)["shared"]))) > 0,
    )
    row = lambda family, confirmed, share, shared: F.struct(
        family.alias("family"), F.lit(confirmed).alias("confirmed"), share.alias("share"), shared.alias("shared")
    )
    guess = F.array(row(names[F.col("label")], False, F.col("every")[0]["share"], F.slice(F.col("own"), 1, 0)))
    found = (
        near.withColumn("sure", sure)
        .withColumn(
            "found",
            F.when(F.size("sure") > 0, F.transform("sure", lambda m: row(m["family"], True, m["share"], m["shared"])))
            .when(F.col("score") >= believed, guess),
        )
        .select("doc_id", "row", "lines", "words", "score", F.explode_outer("found").alias("found"))
        .filter("found IS NOT NULL")
    )
    # Of words across lines, the lines that share triples with the template.
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("words") - TRIPLE + 1, F.lit(1))),
        lambda i: F.array_contains("found.shared", F.concat_ws(" ", F.slice("words", i, TRIPLE))),
    )
    start = F.coalesce(F.array_min("at"), F.lit(1))
    stop = F.coalesce(F.array_max("at") + TRIPLE - 1, F.size("words"))
    return found.withColumn("at", at).select(
        "doc_id", "row", "score", "found.family", "found.confirmed", "found.share",
        F.element_at("lines", start).alias("first"),
        F.element_at("lines", F.least(stop, F.size("words"))).alias("last"),
        (F.element_at("lines", F.lit(1)) < F.element_at("lines", F.lit(-1))).alias("across"),
    )


def without_repeats(found: DataFrame) -> DataFrame:
    """One row for each statement that lines and words across lines both hold."""
    keys = ["doc_id", "row", "across", "first", "last", "family", "confirmed"]
    once = found.groupBy(*keys).agg(F.max("share").alias("share"), F.max("score").alias("score"))
    every = once.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("across", "first", "last", "family", "confirmed", "share", "score")).alias("every")
    )

    def stays(one: Column, others: Column) -> Column:
        def covers(other: Column) -> Column:
            overlap = (other["first"] <= one["last"]) & (other["last"] >= one["first"])
            same = other["family"] == one["family"]
            whole = other["confirmed"] & ~one["confirmed"] & (same | (one["family"] == UNKNOWN))
            # Lines before words across them; a wider match of the same family adds nothing.
            line = one["across"] & ~other["across"]
            narrower = one["across"] & other["across"] & (other["last"] - other["first"] < one["last"] - one["first"])
            like = same & (other["confirmed"] | ~one["confirmed"])
            return overlap & F.when(one["confirmed"], (line | narrower) & like).otherwise(
                F.when(one["across"], whole | (line & (same | (one["family"] == UNKNOWN)))).otherwise(whole & other["across"])
            )

        return ~F.exists(others, covers)

    left = every.select("doc_id", F.explode_outer(F.filter("every", lambda one: stays(one, F.col("every")))).alias("one"))
    return left.filter("one IS NOT NULL").select("doc_id", "one.*")


def scan_licenses(
    df: DataFrame, negatives: int = NEGATIVES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Statements of a licence: ``doc_id``, ``paragraph`` (number from 0 of the line where
    it begins), ``family``, ``score``, ``template_share`` and ``confirmed``.

    A multinomial logistic regression over hashed single words and word pairs, fitted to
    the templates and to at most ``negatives`` paragraphs of ``df``, scores every line of
    every text, and every hard-wrapped paragraph across its line ends, in overlapping
    windows of ``WINDOW`` words. The score is the probability of any licence. Templates
    with ``TEMPLATE_SHARE`` of their word triples there confirm their families, whichever
    is likeliest; a paragraph may state several. Without any, a score above the calibrated
    one gives an unconfirmed row with the likeliest family, or ``unknown``, and the
    largest share of any template; across lines, from the first line of its window.

    A null or empty text has no paragraphs; nor has an empty table, which gives no rows.
    Repeated rows give repeated results, and a null id stays null. Other columns are not
    read. Scores are rounded to four digits, as sums of doubles depend on the order.
    """
    spark = df.sparkSession
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    templates = template_table(spark)
    rows = training_rows(docs, templates, negatives)
    model = train(rows)
    parts = paragraphs(docs.withColumn("row", F.monotonically_increasing_id()))
    # At most as many ids as there are negatives.
    taught = [r[0] for r in rows.filter("label = 0 AND n % 4 != 0 AND doc_id IS NOT NULL").select("doc_id").distinct().collect()]
    held = ~F.coalesce(F.col("doc_id").isin(taught), F.lit(False))
    counted = Observation("paragraphs")
    every = parts.withColumn("held", held).observe(counted, F.coalesce(F.sum(F.col("held").cast("long")), F.lit(0)).alias("held"))
    likely = stage(scored(model, every).filter(F.col("score") >= LEAST_SCORE), "licence-likely")
    believed = threshold(likely, templates, observed_counts(counted, "held")["held"])
    found = without_repeats(compared(likely, templates, believed))
    return found.select(
        "doc_id",
        F.col("first").alias("paragraph"),
        "family",
        F.round("score", 4).alias("score"),
        F.round("share", 4).alias("template_share"),
        "confirmed",
    )

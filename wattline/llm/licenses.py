"""License scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of a text are joined by hash, and then by content, to the places of
those pairs in short license templates. A match votes for its diagonal, the place in the text minus
the place in the template. Diagonals close to each other are merged, which bridges inserted
and missing words, and a span is verified by the share of its template's pairs that it holds.
Templates are fixed and few, so they are broadcast; matches are rare, so little is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm.text import lower_ascii

#: Phrases whose every place counts, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of public license notices, with labels of this scan.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words are split at all ASCII characters but digits and small letters, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals at most this far apart are merged.
SLACK = 2
#: Least share of a notice's word pairs that a span holds.
COVERAGE = 0.7


def template_values(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> str:
    """SQL rows (template, label, base, pairs, place, pair) of all word pairs of the templates."""
    rows = []
    for number, (text, label, base) in enumerate(
        [(t, l, True) for t, l in phrases.items()] + [(t, l, False) for t, l in notices.items()]
    ):
        words = text.split(" ")
        pairs = len(words) - 1
        if not 1 <= pairs <= 62:
            raise ValueError(f"a template has 2 to 63 words: {text!r}")
        for place in range(pairs):
            rows.append(f"({number}, '{label}', {base}, {pairs}, {place}, '{words[place]} {words[place + 1]}')")
    return "values " + ", ".join(rows)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places where the words of one of ``phrases`` stand consecutively, and the
    first and last of these places, in words from 0, are null where there is none. ``base_labels`` are the labels of
    these phrases, ``labels`` those and the labels of verified notices. ``score`` is the
    largest share of a template's word pairs in a verified span, 0 without one. Null, empty and
    wordless texts have no words. A document is a pair of id and text; rows that repeat both
    give one row. Ids may be null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.filter(F.split(lower_ascii(text), SEPARATORS), lambda word: word != "").alias("words"),
    ).select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "words")
    pairs = F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - 1),
        lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)),
    )
    # The last element, a blank, is no word pair: it matches the row of its own in the templates, once in every text.
    pairs = F.when(F.col("n_words") > 1, F.concat(pairs, F.array(F.lit(" ")))).otherwise(F.array(F.lit(" ")))
    rolling = words.select("doc_id", "text_hash", "n_words", F.posexplode(pairs).alias("at", "pair")).withColumn(
        "hash", F.xxhash64("pair")
    )
    templates = spark.sql(
        f"select * from ({template_values(phrases, notices)}, (-1, '', false, 1, 0, ' ')) "
        "t(template, label, base, pairs, place, known)"
    ).withColumn("hash", F.xxhash64("known"))
    votes = (
        rolling.join(F.broadcast(templates), "hash")
        .where("pair = known")
        .withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("doc_id", "text_hash", "template", "label", "base", "pairs", "diagonal")
        .agg(
            F.max("n_words").alias("n_words"),
            F.bit_or(F.expr("shiftleft(1L, place)")).alias("seen"),
        )
    )
    line = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(line) <= SLACK
    # Merging is for notices: every diagonal of a phrase is a place of its own.
    starts = F.when(near & ~F.col("base"), 0).otherwise(1)
    spans = (
        votes.withColumn("span", F.sum(starts).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_hash", "template", "label", "base", "pairs", "span")
        .agg(
            F.max("n_words").alias("n_words"),
            F.min("diagonal").cast("long").alias("start"),
            (F.bit_count(F.bit_or("seen")) / F.col("pairs")).alias("share"),
        )
    )
    phrase = F.col("base") & (F.col("share") == 1)
    notice = ~F.col("base") & (F.col("template") >= 0) & (F.col("share") >= COVERAGE)

    def joined(found):
        return F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",")

    return spans.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        joined(phrase).alias("base_labels"),
        joined(phrase | notice).alias("labels"),
        F.coalesce(F.max(F.when(phrase | notice, F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("text_hash")

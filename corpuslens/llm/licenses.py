"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram and 3-gram of a document is joined by its hash to the places where license templates have
it. A match votes for the diagonal (its place in the document less its place in the template); a copy of a template
is a diagonal with many votes. Neighbouring diagonals, which inserted or missing words cause, are merged; each
merged span is then verified: its votes must cover enough of the template and it must not be much longer.

Defined results: null and empty texts have no words and no labels; a null doc_id is a value like others; repeated
rows give equal rows each; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm import license_texts
from corpuslens.llm.common import gram_hash, words_of

#: Exact phrases: label, words. Fixed values of the contract.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Notices and opening sentences of well-known licenses, matched with gaps: label, words, share of the grams that must
#: vote. One line names a version, so all of it must be there; longer passages may be altered.
NOTICES = [
    ("gpl-3", "licensed under the gnu general public license version 3", 1.0),
    ("gpl-2", "licensed under the gnu general public license version 2", 1.0),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", 0.8),
    ("apache-2.0", "licensed under the apache license version 2 0", 1.0),
    ("cc-by-4.0", "licensed under cc by 4 0", 1.0),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", 1.0),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", 1.0),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 1.0),
    ("mit-line", "released under the mit license", 1.0),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", 0.8),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
]
#: Whole texts are found in altered copies too: so much of their grams must vote.
TEXT_SHARE = 0.6
NOTICES += [(label, " ".join(re.findall("[0-9a-z]+", text.lower())), TEXT_SHARE) for label, text in license_texts.TEXTS]
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals at most so far apart belong to one copy: so many words, or one in so many of the template's.
SLACK, SLACK_SHARE = 2, 16
#: Length of a span at most, against the notice's.
STRETCH = 1.5


def _templates(spark: SparkSession, phrases, notices) -> DataFrame:
    rows = [(label, words, PHRASE_K, True, 1.0) for label, words in phrases] + [(label, words, NOTICE_K, False, share) for label, words, share in notices]
    values = ", ".join(f"({i}, '{label}', '{words}', {k}, {str(exact).lower()}, {share}D)" for i, (label, words, k, exact, share) in enumerate(rows))
    return spark.sql(f"SELECT tid, label, split(words, ' ') AS tw, k, exact, share FROM VALUES {values} AS t(tid, label, words, k, exact, share)")


def _grams(templates: DataFrame, k: int) -> DataFrame:
    """hash -> places in templates. Bounded by the template lists, which are code."""
    x = templates.filter(F.col("k") == k).select("tid", "tw", F.posexplode("tw").alias("tpos", "w"))
    x = x.select("tid", "tpos", gram_hash(F.col("tw"), F.col("tpos"), k, F.size("tw")).alias(f"h{k}"), F.concat_ws(" ", F.slice("tw", F.col("tpos") + 1, k)).alias("gram"))
    x = x.filter(F.col(f"h{k}").isNotNull())
    return x.groupBy(f"h{k}").agg(F.collect_list(F.struct("tid", "tpos", "gram")).alias(f"g{k}"))


def license_clusters(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per (document, template, merged diagonal), and one with tid -1 per document, which holds its word count
    and how many equal rows there are. Columns: doc_id, th (hash of the text), tid, n_words, copies, votes, lo, hi."""
    spark = docs.sparkSession
    templates = _templates(spark, phrases, notices)
    n, pos = F.size("w") - 1, F.col("pos")  # the last element is a mark that stands for the document itself
    x = docs.select("doc_id", F.xxhash64("text").alias("th"), F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("w"))
    x = x.select("doc_id", "th", "w", F.posexplode_outer("w").alias("pos", "first"))
    for k in (PHRASE_K, NOTICE_K):
        x = x.withColumn(f"h{k}", gram_hash(F.col("w"), pos, k, n))
    for k in (PHRASE_K, NOTICE_K):
        x = x.join(F.broadcast(_grams(templates, k)), f"h{k}", "left")
    own = F.array(F.struct(F.lit(-1).alias("tid"), F.lit(0).alias("tpos"), F.lit(None).cast("string").alias("gram")))
    none = F.filter(own, lambda _: F.lit(False))
    x = x.filter((pos == n) | F.col("g2").isNotNull() | F.col("g3").isNotNull())
    x = x.withColumn("hit", F.explode(F.when(pos == n, own).otherwise(F.concat(F.coalesce("g2", none), F.coalesce("g3", none)))))
    hit = F.col("hit")
    same = hit["gram"] == F.concat_ws(" ", F.slice("w", pos + 1, F.size(F.split(hit["gram"], " "))))
    x = x.filter(hit["gram"].isNull() | same)
    x = x.groupBy("doc_id", "th", hit["tid"].alias("tid"), F.when(hit["tid"] >= 0, pos - hit["tpos"]).otherwise(0).alias("diag"))
    x = x.agg(F.max(n).alias("n_words"), F.count("*").alias("copies"), F.collect_set(hit["tpos"]).alias("tset"))
    x = x.repartition("doc_id", "th")  # serves the window and all later groupings
    along = Window.partitionBy("doc_id", "th", "tid").orderBy("diag")
    slack = F.when(F.col("tid") < len(phrases), -1)
    for i, (_, words, _) in enumerate(notices, len(phrases)):
        slack = slack.when(F.col("tid") == i, max(SLACK, len(words.split()) // SLACK_SHARE))
    x = x.withColumn("new", (F.col("diag") - F.lag("diag").over(along) > slack).cast("int"))
    x = x.withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(along))
    return x.groupBy("doc_id", "th", "tid", "cluster").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("votes"),
        F.min(F.col("diag") + F.array_min("tset")).alias("lo"), F.max(F.col("diag") + F.array_max("tset")).alias("last"),
    )


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Verified spans: label, exact, first (word, from 0), end (exclusive), coverage; and a row with null label per document."""
    t = _templates(docs.sparkSession, phrases, notices).select("tid", "label", "exact", "k", "share", F.size("tw").alias("tn"))
    x = license_clusters(docs, phrases, notices).join(F.broadcast(t), "tid", "left")
    x = x.withColumn("coverage", F.col("votes") / (F.col("tn") - F.col("k") + 1)).withColumn("end", F.col("last") + F.col("k"))
    good = (F.col("coverage") >= F.col("share")) & (F.col("end") - F.col("lo") <= STRETCH * F.col("tn"))
    x = x.filter((F.col("tid") < 0) | good)
    return x.select("doc_id", "th", "n_words", F.when(F.col("tid") < 0, F.col("copies")).alias("copies"), "label", "exact", F.when(F.col("tid") >= 0, F.col("lo")).alias("first"), F.when(F.col("tid") >= 0, F.col("end")).alias("end"), F.when(F.col("tid") >= 0, F.col("coverage")).alias("coverage"))


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    x = license_spans(docs, phrases, notices)
    base = F.col("exact")
    x = x.groupBy("doc_id", "th").agg(
        F.max(F.when(F.col("label").isNull(), F.col("n_words"))).cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return x.drop("th", "copies", "copy")

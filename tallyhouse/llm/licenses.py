"""License detection with a positional index of rare license words; DataFrame functions only.

1. Each text's license words with their positions are written once (documents without a word of any key phrase have
   none).
2. The document frequency of each license word is counted over all documents.
3. Of each template's key phrase the rarest words (two, or one where it has no more) are the template's postings. All of
   a document's words are looked up in them. A hit gives a template and the place at which it would start; places on
   which all of the template's postings agree are candidates. As the key phrase must stand whole, no place is missed.
4. Candidates are intersected with the document's other license words by relative position. A template is found where
   its mandatory key phrase stands whole and the matched words carry enough of the template's weight.

Fixed phrases (``BASE``) are counted besides, wherever their words stand consecutively.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are judged one by one; a document
in which one place fits several templates has all their labels; rarity ties go to the word first in the alphabet.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import scratch_path

#: Words of a text, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Label, wording, and the phrase in it that must stand whole.
TEMPLATES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0-1.0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "made available under the eclipse public license", "eclipse public license"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)

#: Words too common to be looked up: they only confirm.
COMMON = ("0", "1", "2", "3", "4", "a", "all", "and", "any", "by", "for", "in", "is", "of", "or", "the", "this", "to", "v")

#: Words of each key phrase that are looked up.
LOOKED_UP = 2
LEAST_WEIGHT = 0.6


def _lowered(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def license_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, ``n_words``, ``tokens`` (position and word) and a ``row`` number; written to ``path``."""
    wordings = [w for _, w, _ in TEMPLATES] + [p for p, _ in BASE]
    known = sorted({w for wording in wordings for w in wording.split()})
    keys = sorted({w for p in [k for *_, k in TEMPLATES] + [p for p, _ in BASE] for w in p.split()} - set(COMMON))
    words = docs.select(
        "doc_id", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("__words")
    )
    placed = F.filter(
        F.transform("__words", lambda w, i: F.struct(i.alias("pos"), _lowered(w).alias("w"))), lambda t: t["w"].isin(known)
    )
    relevant = F.exists("__words", lambda w: F.lower(w).isin(keys))
    tokens = F.when(relevant, placed).otherwise(F.array().cast("array<struct<pos:int,w:string>>"))
    found = words.select("doc_id", F.size("__words").cast("long").alias("n_words"), tokens.alias("tokens"))
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def _values(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]))
    )


def _at(k: Column, step: int) -> Column:
    return F.get(F.col("tokens"), k + step)


def _stands(phrase: str, token: Column, k: Column) -> Column:
    """Whether a phrase starts at the k-th token; consecutive words are neighbours in ``tokens``."""
    first, *rest = phrase.split()
    found = token["w"] == first
    for step, word in enumerate(rest, 1):
        found &= (_at(k, step)["w"] == word) & (_at(k, step)["pos"] == token["pos"] + step)
    return F.coalesce(found, F.lit(False))


def word_weights(staged: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each license word over all rows; at most one entry a word of the templates."""
    n = staged.count()
    each = staged.select(F.explode(F.array_distinct(F.transform("tokens", lambda t: t["w"]))).alias("w"))
    counted = {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = {w for _, wording, _ in TEMPLATES for w in wording.split()}
    return {w: math.log((n + 1) / (counted.get(w, 0) + 1)) + 0.01 for w in sorted(words)}


def find_templates(staged: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(row, label, score) of each template that a row holds; ``score`` is the share of the template's weight."""
    spark = staged.sparkSession
    positions, totals, rarest = [], [], []
    for number, (label, wording, key) in enumerate(TEMPLATES):
        words, must = wording.split(), key.split()
        start = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        totals.append((number, label, float(sum(weights[w] for w in words)), len(must)))
        for place, w in enumerate(words):
            positions.append((number, place, w, weights[w], int(start <= place < start + len(must))))
        rare = [(-weights[w], w, place) for place, w in enumerate(must, start) if w not in COMMON]
        looked_up = sorted(rare)[:LOOKED_UP]
        rarest += [(number, place, w, len(looked_up)) for _, w, place in looked_up]
    postings = _values(spark, positions, ["template", "place", "w", "weight", "must"])
    lookup = _values(spark, rarest, ["template", "place", "w", "n_looked_up"])
    templates = _values(spark, totals, ["template", "label", "total", "n_must"])

    tokens = staged.filter(F.size("tokens") > 0).select("row", F.inline("tokens"))
    hits = tokens.join(F.broadcast(lookup), "w")
    candidates = (
        hits.groupBy("row", "template", "n_looked_up", (F.col("pos") - F.col("place")).alias("start"))
        .agg(F.count(F.lit(1)).alias("agreeing"))
        .filter(F.col("agreeing") == F.col("n_looked_up"))
        .select("row", "template", "start")
    )
    wanted = candidates.join(F.broadcast(postings), "template").withColumn("pos", F.col("start") + F.col("place"))
    found = (
        wanted.join(tokens, ["row", "pos", "w"])
        .groupBy("row", "template", "start")
        .agg(F.sum("weight").alias("got"), F.sum("must").alias("n_must"))
        .join(F.broadcast(templates), ["template", "n_must"])
        .withColumn("score", F.least(F.col("got") / F.col("total"), F.lit(1.0)))
        .filter(F.col("score") >= LEAST_WEIGHT)
    )
    return found.groupBy("row", "label").agg(F.max("score").alias("score"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of words and base phrases, labels and a score from 0 to 1.

    The score is 1 where a base phrase stands, else the best share of a found template's weight, else 0.
    """
    staged = license_words(docs, scratch_path(docs.sparkSession, "license-words"), text)
    found = find_templates(staged, word_weights(staged))
    per_row = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    labels_at = lambda t, k: F.array_compact(F.array(*[F.when(_stands(p, t, k), F.lit(label)) for p, label in BASE]))
    at = lambda t, k: F.struct(t["pos"].cast("long").alias("pos"), labels_at(t, k).alias("labels"))
    places = F.filter(F.transform("tokens", at), lambda t: F.size(t["labels"]) > 0)
    based = staged.withColumn("places", places).select("row", "doc_id", "n_words", "places")
    base = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda t: t["labels"]))))
    n_base = F.aggregate("places", F.lit(0).cast("long"), lambda n, t: n + F.size(t["labels"]))
    joined = based.join(per_row, "row", "left")
    more = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("places", lambda t: t["pos"])).alias("first_word"),
        F.array_max(F.transform("places", lambda t: t["pos"])).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, more))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0))).alias("score"),
    )

"""License scans as an exact set-similarity join. DataFrame operations only.

A text block is a line, or, for notices that are wrapped or stand within longer lines, any stretch of words that is about
as long as the template, wherever lines end (``similar_windows``). It matches a template if it holds at least ``THRESHOLD`` of the template's distinct words.
Template words are ordered by their frequency in the whole corpus, rarest first. A block that matches must hold one of a
template's first ``size - need + 1`` words (prefix filter), must have at least ``need`` words (length filter), and from
the first shared prefix word on both sides must still have ``need`` words left (positional filter). Blocks meet templates
in an equi-join on prefix words; what passes the filters is verified by its exact overlap.

Only the template words' frequencies (their number is fixed) reach the driver, and only the prefix index (as small) is
broadcast. Text never moves: blocks are filtered where they are read, and only ids of matching blocks are shuffled.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening sentences of public license notices, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.9
#: Outside of words, upper case included.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    cleaned = "".join(c if c.isalnum() else " " for c in text.lower())
    return list(dict.fromkeys(cleaned.split()))


def window_length(text: str, threshold: float) -> int:
    """How many words a stretch may have that is held against a template: repeats count, and as many others may stand
    between as may be missing."""
    return ceil(len("".join(c if c.isalnum() else " " for c in text).split()) / threshold - 1e-9)


def needed(size: int, threshold: float) -> int:
    """The least number of a template's ``size`` words that meets ``threshold``."""
    return max(1, ceil(threshold * size - 1e-9))


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered. (Other letters stay letters under ``lower``, so no border moves.)"""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _places(ws: Column, phrase: str) -> Column:
    """The word numbers at which ``phrase`` starts in the words ``ws``. They are bound to a lambda's name, so that the
    text is split once, not at every word."""
    first, *rest = phrase.split()

    def search(bound: Column) -> Column:
        def here(i: Column) -> Column:
            hit = F.get(bound, i) == first
            for k, w in enumerate(rest, 1):
                hit = hit & F.coalesce(F.get(bound, i + k) == w, F.lit(False))
            return hit

        return F.filter(F.sequence(F.lit(0), F.size(bound) - 1), here)

    return F.get(F.transform(F.array(ws), search), F.lit(0))


def phrase_hits(text: Column, phrases: dict[str, str] = PHRASES) -> tuple[Column, Column]:
    """(places, labels): where any phrase starts, and the labels of those that do. Words are listed only where a cheap
    search finds some phrase's words with gaps between them."""
    seen = F.lower(text).rlike("|".join(GAP.join(p.split()) for p in phrases))
    ws = words(text)
    each = {p: F.when(seen, _places(ws, p)) for p in phrases}
    places = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<int>")) for x in each.values()]))
    labels = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(phrases[p])) for p, x in each.items()]))
    return places, F.array_distinct(labels)


def ranked_vocabulary(texts: DataFrame, templates: list[list[str]]) -> list[str]:
    """The words of all templates by the number of documents that hold them, rarest first."""
    vocabulary = sorted({w for t in templates for w in t})
    literal = F.array(*[F.lit(w) for w in vocabulary])
    held = texts.select(F.explode(F.array_intersect(literal, words(F.col("text")))).alias("word"))
    count = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _prefix_index(docs: DataFrame, templates, threshold: float) -> tuple[list[str], list[tuple]]:
    """(words, index): template words, rarest first, and a row for each word of each template's prefix."""
    sets = [(label, template_words(t), window_length(t, threshold)) for label, t in templates]
    order = {w: n for n, w in enumerate(ranked_vocabulary(docs, [t for _, t, _ in sets]))}
    index = []
    for n, (label, t, length) in enumerate(sets):
        ranked, need = sorted(t, key=order.__getitem__), needed(len(t), threshold)
        prefix = ranked[: len(t) - need + 1]
        index += [(w, n, label, ranked, prefix, need, at, length) for at, w in enumerate(prefix)]
    return sorted(order, key=order.__getitem__), index


_INDEX = "word string, template int, label string, ranked array<string>, prefix array<string>, need int, at int, length int"


def similar_windows(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, text_key, start, label, containment): stretches of :func:`window_length` words, line ends or not, that
    hold ``threshold`` of a template's distinct words.

    Such a stretch holds a word of the template's prefix. Around each place of one, the words within reach are taken along;
    if too few of the template's are among them, no stretch there can match; else all that cover the place are compared
    and the best, the first of equals, is returned. So work grows with the places of rare words, and rows have a bounded size.
    """
    _, index = _prefix_index(docs, templates, threshold)
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(index, _INDEX))
    rare = F.array(*[F.lit(w) for w in sorted({row[0] for row in index})])
    widest = max(row[7] for row in index)

    def places(bound: Column) -> Column:
        def here(w: Column, i: Column) -> Column:
            low = F.greatest(i - (widest - 1), F.lit(0))
            found = F.struct(w.alias("word"), i.alias("place"), low.alias("low"), F.slice(bound, low + 1, i - low + widest).alias("near"))
            return F.when(F.array_contains(rare, w), found)

        return F.array_compact(F.transform(bound, here))

    met = docs.select("record_id", "text_key", F.explode(F.flatten(F.transform(F.array(words(F.col("text"))), places))).alias("p"))
    met = met.select("record_id", "text_key", "p.*").join(prefixes, "word").filter(F.size(F.array_intersect("near", "ranked")) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("place") - F.col("length") + 1, F.lit(0)), F.col("place"))
    held = lambda s: F.size(F.array_intersect(F.slice("near", s - F.col("low") + 1, F.col("length")), F.col("ranked")))
    best = F.array_max(F.transform(starts, lambda s: F.struct(held(s).alias("overlap"), (-s).alias("before"))))
    met = met.withColumn("best", best).filter(F.col("best.overlap") >= F.col("need"))
    return met.select("record_id", "text_key", (-F.col("best.before")).alias("start"), "label", (F.col("best.overlap") / F.size("ranked")).alias("containment"))


def similar_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, text_key, line, label, containment): every line of ``text`` that holds ``threshold`` of a template."""
    ordered, index = _prefix_index(docs, templates, threshold)
    # Its size is that of the templates.
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(index, _INDEX))
    vocabulary = F.array(*[F.lit(w) for w in ordered])
    rare = F.array(*[F.lit(w) for w in sorted({row[0] for row in index})])
    least = min(row[5] for row in index)
    # The words are made inside the generator: a filter on them, pushed below a projection, would make them twice.
    lines = F.transform(F.split(F.col("text"), "\n"), lambda line: F.array_distinct(words(line)))
    blocks = docs.select("record_id", "text_key", F.posexplode(lines).alias("line", "held"))
    blocks = blocks.filter((F.size("held") >= least) & F.arrays_overlap(F.col("held"), rare))
    blocks = blocks.select("record_id", "text_key", "line", F.size("held").alias("size"), F.array_intersect(vocabulary, F.col("held")).alias("known"))
    met = blocks.withColumn("word", F.explode(F.array_intersect(F.col("known"), rare))).join(prefixes, "word")
    left = F.size("known") - F.array_position("known", F.col("word")).cast("int") + 1
    met = met.filter((F.col("size") >= F.col("need")) & (F.least(F.size("ranked") - F.col("at"), left) >= F.col("need")))
    met = met.filter(F.get(F.array_intersect("prefix", "known"), F.lit(0)) == F.col("word"))
    overlap = F.size(F.array_intersect("known", "ranked"))
    return met.filter(overlap >= F.col("need")).select("record_id", "text_key", "line", "label", (overlap / F.size("ranked")).alias("containment"))


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, blocks: str = "lines") -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases, others from ``blocks`` similar to templates: ``lines``, or ``windows`` of words over line
    ends, which also find wrapped notices and do not take words scattered over a long line for one. score is 1 for a base label, else the largest
    containment, else 0. Null text counts as empty: no words, empty labels, null places. Rows that repeat in id and text
    give equal rows; rows that share an id but not the text are scored apart. Null ids are kept. No rows: none. Other
    columns are not carried.
    """
    if blocks not in ("lines", "windows"):
        raise ValueError(f"unknown blocks: {blocks}")
    docs = df.select(F.col(id_col).alias("record_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    places, found = phrase_hits(F.col("text"))
    base = docs.select(
        "record_id",
        "text_key",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        places.alias("places"),
        found.alias("found"),
    )
    similar = similar_blocks if blocks == "lines" else similar_windows
    matched = similar(docs, templates, threshold)
    matched = matched.groupBy("record_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    matched = matched.select(F.col("record_id").alias("m_id"), F.col("text_key").alias("m_key"), "more", "best")
    both = base.join(matched, F.col("record_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return both.select(
        F.col("record_id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("found")).alias("base_labels"),
        joined(F.concat(F.col("found"), F.coalesce("more", none))).alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _oracle() -> str:
    """DuckDB: every line against every template, and phrases by lists of words."""
    sets = [(label, template_words(t)) for label, t in TEMPLATES]
    rows = ", ".join(f"('{label}', {_quoted(t)}, {needed(len(t), THRESHOLD)})" for label, t in sets)
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at = lambda p: " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1))
    hits = ", ".join(f"list_filter(range(0, len(w)), lambda i: {at(p)}) as p{n}" for n, p in enumerate(PHRASES))
    tags = ", ".join(f"case when len(p{n}) > 0 then '{label}' end" for n, label in enumerate(PHRASES.values()))
    every = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    return f"""with t(label, ws, need) as (values {rows}),
    d as (select row_number() over () as r, doc_id, {low} as txt from documents),
    l as (select r, list_distinct(regexp_extract_all(line, {word})) as have from (select r, unnest(string_split(txt, chr(10))) as line from d)),
    m as (select r, list(distinct label) as more, max(len(list_intersect(have, ws)) / len(ws)::double) as best from l join t on len(have) >= need and len(list_intersect(have, ws)) >= need group by r),
    p as (select r, doc_id, len(w)::bigint as n_words, {hits} from (select r, doc_id, regexp_extract_all(txt, {word}) as w from d)),
    q as (select r, doc_id, n_words, {every} as places, list_distinct(list_filter([{tags}], lambda x: x is not null)) as found from p)
    select doc_id, n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
        array_to_string(list_sort(found), ',') as base_labels,
        array_to_string(list_sort(list_distinct(found || coalesce(more, []))), ',') as labels,
        case when len(found) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
    from q left join m using (r)"""


OP3_SQL = _oracle()


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, base phrases and license labels."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

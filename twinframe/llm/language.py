"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ``DEPTH`` most frequent character n-grams (n from 1 to 3) of a language, by rank. A document's own most
frequent n-grams are ranked the same way; its distance to a language is the sum of how far each is out of place, n-grams
that the profile lacks counting ``DEPTH``.

Learning counts n-grams per language in the tasks, sums them in one shuffle and keeps ``DEPTH`` rows a language, so the
model's size is fixed by its parameters whatever the corpus. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from twinframe.llm.chars import CODE_BITS, chunks, coded, counted, grams
from twinframe.llm.common import in_batches, remainder, without

ORDERS = (1, 2, 3)
DEPTH = 400
#: Languages that texts are compared with at a time; bounds memory, not how many there may be.
TOGETHER = 64
#: What a text without letters is said to be.
UNDETERMINED = "und"
_GRAM_BITS = CODE_BITS * max(ORDERS) + 2


def _keys(texts: list[str | None], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of (group, n-gram); the group is the text's number unless given."""
    codes, doc = coded(texts)
    found = []
    for n in ORDERS:
        gram, own = grams(codes, doc, n)
        if n == 1:
            gram, own = gram[gram != 0], own[gram != 0]
        of = own if group is None else group[own]
        found.append(of.astype(np.uint64) << np.uint64(_GRAM_BITS) | np.uint64(n << (CODE_BITS * max(ORDERS))) | gram)
    return counted(np.concatenate(found))


def profiles(df: DataFrame, *, lang_col: str = "lang", text_col: str = "text", depth: int = DEPTH) -> dict[str, np.ndarray]:
    """The n-grams of each language in ``df``, most frequent first (ties: smaller code). Rows without a language teach nothing.

    Every value of ``lang_col`` is a language, however many there are: ``depth`` numbers of each reach the driver and the
    tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            group = np.fromiter((names.setdefault(x, len(names)) for x in langs), np.int64, len(langs))
            for s in chunks(texts):
                k, c = _keys(texts[s], group[s])
                keys, sums = counted(np.concatenate([keys, k]), np.concatenate([sums, c]))
        by_number = np.array([*names, ""], dtype=object)
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            lang = by_number[(k >> np.uint64(_GRAM_BITS)).astype(np.int64)]
            gram = (k & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram), pa.array(sums[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    taught = in_batches(df).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    total = taught.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= depth)
    found: dict[str, list] = {}
    for r in kept.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(found[lang])], np.uint64) for lang in sorted(found)}


class Ranker:
    """Distances of texts to profiles."""

    def __init__(self, by_lang: dict[str, np.ndarray], depth: int = DEPTH):
        self.langs, self.depth = [*by_lang], depth
        #: For each ``TOGETHER`` languages: the n-grams that any of them has, and their ranks in each (-1: none).
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(self.langs), TOGETHER):
            own = [by_lang[x] for x in self.langs[at : at + TOGETHER]]
            known = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
            ranks = np.full((len(known) + 1, len(own)), -1, np.int32)
            for n, g in enumerate(own):
                ranks[np.searchsorted(known, g), n] = np.arange(len(g))
            self.tables.append((known, ranks))

    def distances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) sums of places out, and the number of n-grams ranked in each text."""
        out, ranked = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        for s in chunks(texts):
            out[s], ranked[s] = self._distances(texts[s])
        return out, ranked

    def _distances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        keys, count = _keys(texts)
        if not len(keys):
            return np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        doc = (keys >> np.uint64(_GRAM_BITS)).astype(np.int64)
        gram = keys & np.uint64((1 << _GRAM_BITS) - 1)
        # Within a text: most frequent first, then by code, which is the order that the keys have already.
        place, many = np.uint64(len(keys).bit_length()), np.uint64(int(count.max()).bit_length())
        order = np.sort(doc.astype(np.uint64) << (place + many) | (count.max() - count).astype(np.uint64) << place | np.arange(len(keys), dtype=np.uint64))
        order = (order & np.uint64((1 << int(place)) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.diff(np.r_[starts, len(doc)])
        rank = np.arange(len(doc)) - np.repeat(starts, sizes)
        top = rank < self.depth
        rank, doc, gram = rank[top], doc[top], gram[order[top]]
        out, ranked = np.zeros((len(texts), len(self.langs)), np.int64), np.bincount(doc, minlength=len(texts))
        first = 0
        for known, ranks in self.tables:
            at = np.searchsorted(known, gram)
            at[at < len(known)] = np.where(known[at[at < len(known)]] == gram[at < len(known)], at[at < len(known)], len(known))
            theirs = ranks[at]
            off = np.where(theirs < 0, self.depth, np.abs(theirs - rank[:, None]))
            for n in range(ranks.shape[1]):
                out[:, first + n] = np.bincount(doc, off[:, n], len(texts))
            first += ranks.shape[1]
        return out, ranked

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text (ties: first by name), and 1 less its mean distance as a part of the largest."""
        off, ranked = self.distances(texts)
        lettered = ranked > 0
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = off.argmin(axis=1)
        score = np.where(lettered, 1.0 - off[np.arange(len(texts)), best] / (self.depth * np.maximum(ranked, 1.0)), 0.0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], score


def identify(df: DataFrame, by_lang: dict[str, np.ndarray], *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``df`` with lang_pred and lang_score (0 to 1); input columns of these names are replaced.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text if there are no profiles.
    Ties go to the language first by name. Very long texts are ranked whole. Repeated rows get equal results.
    """

    @pandas_udf("lang_pred string, lang_score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(by_lang, depth)
        for texts in batches:
            lang, score = ranker.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": lang, "lang_score": score})

    kept = without(in_batches(df), ["lang_pred", "lang_score"])
    marked = kept.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("found"))
    return marked.select("row.*", "found.*")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 3) == 1
    by_lang = profiles(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text"), by_lang)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

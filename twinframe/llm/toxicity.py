"""Toxicity by class-conditional Kneser-Ney models.

Two models over letters, toxic and ordinary, predict each letter from the four before it. Each discounts its own counts
and gives what the discount frees to the next shorter context, by its own continuation counts (in how many contexts a gram
was seen) down to three letters. Below that both share one distribution, of the continuation counts of both classes
together, so that what is rare in either weighs the same on both sides. A text's log-likelihoods are compared per letter,
over the whole text and over its stretches, and a logistic function turns the two differences into a score.

Counts are made in the tasks over all labelled rows and summed in one shuffle; all probabilities are joins and sums of the
counts. The model that reaches the tasks holds every n-gram that was counted, so it grows with the distinct n-grams of the
labelled texts. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from twinframe.llm.chars import CODE_BITS, chunks, coded, counted, grams
from twinframe.llm.common import in_batches, materialise, remainder, without

ORDER = 5
#: Grams up to this length are counted for both classes together.
SHARED = 2
DISCOUNT = 0.75
#: Rows of the model's tables that one job sends to the driver, about; a table is fetched in as many jobs as it takes.
FETCHED = 1 << 21
#: Letters of the stretches that are compared besides the whole text.
STRETCH = 16
#: Labelled rows that fit the logistic function, at most (those of least hash).
CALIBRATION_ROWS = 20_000
#: Up to so many labels they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_LABELS = 1_000_000


class GramTable:
    """n-grams with values, found by open addressing with numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = np.vstack([values, np.zeros((1, values.shape[1]), np.float32)]).astype(np.float32)
        self.bits = max(4, (len(keys) + len(keys) // 2).bit_length())
        self.keys = np.full(1 << self.bits, ~np.uint64(0), np.uint64)
        self.row = np.full(1 << self.bits, len(keys), np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self.keys[at] == ~np.uint64(0)
            self.keys[at[free]] = keys[rest[free]]
            mine = self.keys[at] == keys[rest]
            self.row[at[mine]] = rest[mine]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; the last row of values, all 0, if it has none."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        row = np.where(seen == keys, self.row[slot], len(self.values) - 1)
        rest = np.flatnonzero((seen != keys) & (seen != ~np.uint64(0)))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[rest]]
            hit = seen == keys[rest]
            row[rest[hit]] = self.row[slot[rest[hit]]]
            rest = rest[~hit & (seen != ~np.uint64(0))]
        return row


@dataclass
class Model:
    """By order: log-probabilities (toxic, ordinary) of the last letter of seen grams, and the log of the mass that each
    context frees for what is not among them."""

    seen: dict[int, GramTable]
    freed: dict[int, GramTable]
    floor: float
    weights: np.ndarray | None = None

    def _logs(self, gram: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(gram), 2), self.floor, np.float32)
        table = self.seen[n]
        row = table.find(gram)
        out = table.values[row]
        new = np.flatnonzero(row == len(table.values) - 1)
        if len(new):
            shorter = gram[new] & np.uint64((1 << (CODE_BITS * (n - 1))) - 1)
            freed = self.freed[n]
            out[new] = freed.values[freed.find(gram[new] >> np.uint64(CODE_BITS))] + self._logs(shorter, n - 1)
        return out

    def logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letter log-likelihoods, toxic and ordinary; their text) for every letter that four others precede."""
        gram, doc = grams(*coded(texts), ORDER)
        return self._logs(gram, ORDER), doc

    def features(self, texts: list[str | None]) -> np.ndarray:
        """(texts x 3): mean toxic and ordinary log-likelihood a letter, and the log of the mean likelihood ratio of the text's
        stretches (of ``STRETCH`` letters, one from each letter on, cut at the end); zeros for a text of under five letters.

        The mean over stretches is that of a text with one toxic stretch, wherever it stands: unlike the largest, it does
        not rise with the text's length.
        """
        out = np.zeros((len(texts), 3))
        for s in chunks(texts):
            part = out[s]
            logs, doc = self.logs(texts[s])
            if not len(doc):
                continue
            n = np.bincount(doc, minlength=len(part))
            has = n > 0
            for k in range(2):
                part[has, k] = np.bincount(doc, logs[:, k], len(part))[has] / n[has]
            gain = np.r_[0.0, np.cumsum((logs[:, 0] - logs[:, 1]).astype(np.float64))]
            ends = np.cumsum(n)
            first = np.arange(len(doc))
            ratio = gain[np.minimum(first + STRETCH, ends[doc])] - gain[first]
            most = np.zeros(len(part))
            most[has] = np.maximum.reduceat(ratio, (ends - n)[has])
            total = np.bincount(doc, np.exp(ratio - most[doc]), len(part))
            part[has, 2] = most[has] + np.log(total[has] / n[has])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1.0 / (1.0 + np.exp(-np.clip(_design(features) @ self.weights, -40, 40)))


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), 10 * (f[:, 0] - f[:, 1]), f[:, 2]])


def _fit_logistic(f: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = _design(f)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * (len(w) - 1))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(record_id, text, y): the texts that have a label; of several labels the largest."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("record_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    texts = in_batches(docs).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).filter("text is not null")
    y = materialise(y, "toxicity-labels")
    return texts.join(F.broadcast(y) if y.count() <= BROADCAST_LABELS else y, "record_id")


def gram_counts(rows: DataFrame, n: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary): how often each n-gram occurs in the texts of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False) > 0
            for s in chunks(texts):
                gram, doc = grams(*coded(texts[s]), n)
                k, c = counted(gram << np.uint64(1) | y[s][doc].astype(np.uint64))
                keys, sums = counted(np.concatenate([keys, k]), np.concatenate([sums, c]))
        for at in range(0, len(keys), 1 << 16):
            k, c = keys[at : at + (1 << 16)], sums[at : at + (1 << 16)]
            t = (k & np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(1)).astype(np.int64)), pa.array(c * t), pa.array(c * (1 - t))], names=["gram", "toxic", "ordinary"])

    return rows.select("text", "y").mapInArrow(count, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _table(df: DataFrame, key: str, values: list[str]) -> GramTable:
    """All rows of ``df``, fetched as Arrow columns: no Python object for each row."""
    parts = max(1, -(-df.count() // FETCHED))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    columns = [F.col(key).alias("k"), *[F.col(v).cast("float") for v in values]]
    rows = pa.concat_tables([df.filter(part == n).select(*columns).toArrow() for n in range(parts)])
    logs = [rows.column(n + 1).to_numpy().astype(np.float32) for n in range(len(values))]
    return GramTable(rows.column(0).to_numpy().astype(np.uint64), np.column_stack(logs).reshape(len(rows), len(values)))


def fit_counts(rows: DataFrame) -> Model:
    """The two models from labelled texts (text, y)."""
    return _from_counts(materialise(gram_counts(rows), "toxicity-grams"))


def _from_counts(counts: DataFrame) -> Model:
    """The two models from the written counts of the longest grams."""
    up = F.shiftrightunsigned
    tail = lambda c, n: c.bitwiseAND(F.lit((1 << (CODE_BITS * n)) - 1))
    both = ("toxic", "ordinary")
    level = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # Continuation counts: types of the next longer gram, in each class or in both together.
        longer = level[n + 1].groupBy(tail(F.col("gram"), n).alias("gram"))
        types = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in both] if n > SHARED else [F.count(F.lit(1)).alias(c) for c in both]
        level[n] = materialise(longer.agg(*types), f"toxicity-{n}")
    letters = level[1].count()
    below, seen, freed = None, {}, {}
    for n in range(1, ORDER + 1):
        context = level[n].groupBy(up("gram", CODE_BITS).alias("context")).agg(
            *[F.sum(c).alias(f"{c}_all") for c in both], *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_types") for c in both]
        )
        for c in both:
            context = context.withColumn(f"{c}_free", F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_all")).otherwise(1.0))
        context = materialise(context, f"toxicity-c{n}")
        joined = level[n].withColumn("context", up("gram", CODE_BITS)).join(context, "context")
        if below is None:
            joined = joined.select("*", *[F.lit(1.0 / (letters + 1)).alias(f"{c}_below") for c in both])
        else:
            shorter = below.select(F.col("gram").alias("short"), *[F.col(f"{c}_p").alias(f"{c}_below") for c in both])
            joined = joined.withColumn("short", tail(F.col("gram"), n - 1)).join(shorter, "short")
        own = lambda c: F.when(F.col(c) > 0, (F.col(c) - DISCOUNT) / F.col(f"{c}_all")).otherwise(0.0)
        p = [(own(c) + F.col(f"{c}_free") * F.col(f"{c}_below")).alias(f"{c}_p") for c in both]
        below = materialise(joined.select("gram", *p), f"toxicity-p{n}")
        seen[n] = _table(below.select("gram", *[F.log(f"{c}_p").alias(c) for c in both]), "gram", [*both])
        freed[n] = _table(context.select("context", *[F.log(f"{c}_free").alias(c) for c in both]), "context", [*both])
    return Model(seen, freed, -float(np.log(letters + 1)))


def fit(rows: DataFrame, *, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Models from all labelled rows (record_id, text, y). The logistic function is fitted with models of three quarters of
    them on the fourth (``calibration_rows`` of it at most), so that it meets texts as new to those models as the texts to
    be scored; then the counts of the fourth are added."""
    part = F.pmod(F.xxhash64(F.col("record_id"), F.lit("part")), F.lit(4))
    most = materialise(gram_counts(rows.filter(part != 0)), "toxicity-grams")
    model = _from_counts(most)
    # On average the wanted number, well within the bound; the limit holds the bound.
    held = rows.filter(part == 0)
    n = held.count()
    order = F.pmod(F.xxhash64(F.col("record_id"), F.lit("row")), F.lit(1 << 20))
    sample = held.filter(order < F.lit(int((1 << 20) * min(1.0, 0.9 * calibration_rows / max(n, 1)))))
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = shipped.value.features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*[pa.array(f[:, k]) for k in range(3)], b.column(1).cast(pa.int32())], names=["a", "b", "c", "y"])

    got = sample.select("text", "y").mapInArrow(measure, "a double, b double, c double, y int").limit(calibration_rows).toPandas()
    y = (got["y"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        weights = _fit_logistic(got[["a", "b", "c"]].to_numpy(), y)
    elif len(y):
        weights = np.array([6.0 if y[0] else -6.0, 0, 0])
    else:
        return model
    shipped.unpersist()
    every = most.unionAll(gram_counts(held)).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = _from_counts(materialise(every, "toxicity-grams"))
    model.weights = weights
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``df`` with toxicity (0 to 1), toxic_log, ordinary_log (per letter) and peak (the stretches); input
    columns of these names are replaced.

    Null, empty and letterless texts have no evidence: both logs 0, and the score is that of no evidence. If there were
    no labels, all scores are 0. Very long texts are scored whole. Repeated rows get equal results.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("toxicity double, toxic_log double, ordinary_log double, peak double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            f = shipped.value.features([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"toxicity": shipped.value.score(f), "toxic_log": f[:, 0], "ordinary_log": f[:, 1], "peak": f[:, 2]})

    kept = without(in_batches(df), ["toxicity", "toxic_log", "ordinary_log", "peak"])
    marked = kept.select(F.struct("*").alias("row"), scored(F.col(text_col)).alias("found"))
    return marked.select("row.*", "found.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder("doc_id", 5) == 0
    model = fit(labelled(docs.select("doc_id", "text").filter(~held_out), labels.filter(~held_out)))
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
        "toxic_log",
        "ordinary_log",
        "peak",
    )

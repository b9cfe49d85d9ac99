"""A training corpus from ``documents``: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import language, mixing, pieces, simhash, toxicity
from twinframe.llm.common import materialise

#: Below this part of the largest similarity to its nearest profile a text is in no known language. On sf0.1 (four languages)
#: no document with letters scores under 0.39; lines of Turkish and Polish score 0.30 and 0.21, random letters 0.21.
LEAST_LANGUAGE_SCORE = 0.35
#: The mixture takes this part of the tokens at hand, in at most one epoch.
MIXED_PART = (4, 5)


def _apart(docs: DataFrame) -> DataFrame:
    """Whole rows besides their texts, so that what an operator adds meets no column of the same name."""
    return docs.select(F.struct("*").alias("row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts unlike all languages at hand; ``lang`` becomes the language found.

    Null and empty texts have no letters. Profiles are learned from the rows with a language; if there are none, all go.
    Repeated rows fare alike. An empty table gives no rows.
    """
    found = language.identify(_apart(docs), language.profiles(docs))
    known = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return known.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents, by a model of the labelled ones among those at hand.

    Without labels nothing is toxic. Null and empty texts hold no evidence and get the score of none. Repeated rows fare
    alike. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    return toxicity.score(_apart(docs), model).filter(F.col("toxicity") < 0.5).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8), null and repeated ids included:
    see :func:`twinframe.llm.simhash.keep_one`."""
    return simhash.keep_one(docs, width=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that a mixture to target weights reads.

    A row is known by its id (null or not), text, language and source; rows that agree in all four stay together if any
    of them is read. Rows without tokens are read if their leaf's prefix reaches them. An empty table gives no rows.
    """
    part, of = MIXED_PART
    known = F.xxhash64("text", "lang", "source")
    read = mixing.mix(
        docs, domain=mixing.source_domain(), weights=mixing.WEIGHTS, budget=F.expr(f"total * {part} div {of}"), max_epochs=1, seed=mixing.SEED, carry={"known": known}
    )
    read = read.select(F.col("doc_id").alias("read_id"), F.col("known").alias("read_as"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), known.alias("own"))
    return whole.join(read, F.col("own_id").eqNullSafe(F.col("read_id")) & (F.col("own") == F.col("read_as")), "left_semi").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left."""
    return pieces.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixture),
    ("SentencePiece encoding", encoding),
]

#: SQL expresses neither the models nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{n + 1}")
    return docs

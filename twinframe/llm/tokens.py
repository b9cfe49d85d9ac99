"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's own pattern; no token reaches over a pre-token, so a text's count is the
sum of its pre-tokens' counts. Pre-tokens are kept in leaves of ``LEAF`` each, and a segment tree over the leaves sums
characters and tokens. An edit is found by character sums from the root. Only the leaves it touches, one leaf of context
before it if the edit lies within the pattern's look-ahead, and as many after it as it takes for the old pre-token
boundaries to come back, are cut and counted anew; then the sums on the paths from these leaves to the root are updated.

A tree is stored as two arrays (characters and tokens of its leaves), so a later batch of edits starts from a table and
never counts untouched text again. Both steps are one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from twinframe.llm.common import in_batches, without

#: The public vocabulary of the queries, and the pattern that it goes with (fixed values).
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a leaf.
LEAF = 64
#: A match of the pattern depends on no more characters behind its end than this.
LOOK_AHEAD = 2
#: Pre-tokens whose counts a worker remembers, and their characters; both bound memory.
REMEMBERED, REMEMBERED_CHARS = 200_000, 1 << 23


class Counter:
    """Counts tokens of pre-tokens, and remembers."""

    def __init__(self, ranks_path: str = RANKS_PATH, pattern: str = PATTERN):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.held = 0

    def counts(self, pre_tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            known.clear()
            self.held = 0
        for p in set(pre_tokens).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
            self.held += len(p)
        return [known[p] for p in pre_tokens]


@lru_cache(maxsize=2)
def counter(ranks_path: str = RANKS_PATH) -> Counter:
    return Counter(ranks_path)


class TokenTree:
    """The leaves of a text and the segment tree over them."""

    def __init__(self, texts: list[str], tokens: list[int], count: Counter):
        self.texts, self.count, self.recounted = texts, count, 0
        self._plant(list(tokens))

    def _plant(self, tokens: list[int]) -> None:
        """The tree over the leaves."""
        texts, self.width = self.texts, 1
        while self.width < len(texts):
            self.width *= 2
        pad = [0] * (self.width - len(texts))
        self.chars = [0] * self.width + [len(t) for t in texts] + pad
        self.tokens = [0] * self.width + tokens + pad
        for n in range(self.width - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @classmethod
    def build(cls, text: str, count: Counter) -> TokenTree:
        cut = count.cut(text)
        n = count.counts(cut)
        return cls(["".join(cut[k : k + LEAF]) for k in range(0, len(cut), LEAF)] or [""], [sum(n[k : k + LEAF]) for k in range(0, len(cut), LEAF)] or [0], count)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], count: Counter) -> TokenTree:
        """From the text and its leaves as kept in a table."""
        at, texts = 0, []
        for c in chars:
            texts.append(text[at : at + c])
            at += c
        return cls(texts or [""], list(tokens) or [0], count)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[list[int], list[int]]:
        k = self.width
        return self.chars[k : k + len(self.texts)], self.tokens[k : k + len(self.texts)]

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``; beyond the end: the last with characters."""
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if at - first >= self.chars[node] and self.chars[node + 1]:
                first += self.chars[node]
                node += 1
        return node - self.width, first

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.width
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are cut to the text."""
        start = max(0, min(start, self.chars[1]))
        end = min(self.chars[1], start + max(0, length))
        low, first = self._leaf(max(0, start - LOOK_AHEAD))
        while first and first + LOOK_AHEAD > start:
            low, first = self._leaf(first - 1)
        high, begins = self._leaf(max(start, end - 1))
        ends = begins + len(self.texts[high])
        region = "".join(self.texts[low : high + 1])
        region = region[: start - first] + replacement + region[end - first :]
        while True:
            context, beyond = "", high + 1
            while beyond < len(self.texts) and len(context) <= LOOK_AHEAD:
                context += self.texts[beyond]
                beyond += 1
            cut, size = [], 0
            for p in self.count.cut(region + context):
                if size >= len(region):
                    break
                cut.append(p)
                size += len(p)
            if size == len(region) or not context:
                break
            # A pre-token reaches over the old boundary: take in the leaves behind it.
            region, high = region + context, beyond - 1
        n = self.count.counts(cut)
        self.recounted += len(cut)
        leaves = high - low + 1
        if len(cut) > 2 * LEAF * leaves:
            # More than the leaves should hold: they are split, and the tree grows.
            parts = [slice(k, k + LEAF) for k in range(0, len(cut), LEAF)]
            tokens = self.tokens[self.width : self.width + len(self.texts)]
            tokens[low : high + 1] = [sum(n[p]) for p in parts]
            self.texts[low : high + 1] = ["".join(cut[p]) for p in parts]
            self._plant(tokens)
            return
        # The new pre-tokens are dealt over the leaves they replace.
        per = max(1, -(-len(cut) // leaves))
        for k in range(leaves):
            part = slice(k * per, (k + 1) * per)
            self._set(low + k, "".join(cut[part]), sum(n[part]))


def token_trees(df: DataFrame, *, text_col: str = "text", ranks_path: str = RANKS_PATH) -> DataFrame:
    """``df`` with n_tokens, leaf_chars and leaf_tokens: the counts of whole texts and the leaves of their trees.

    Null and empty texts have no tokens and one empty leaf. Input columns of these names are replaced.
    """

    @pandas_udf("n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(ranks_path)
        for texts in batches:
            rows = []
            for t in texts:
                tree = TokenTree.build(t or "", count)
                rows.append((tree.total, *tree.leaves()))
            yield pd.DataFrame(rows, columns=["n_tokens", "leaf_chars", "leaf_tokens"])

    kept = without(in_batches(df), ["n_tokens", "leaf_chars", "leaf_tokens"])
    marked = kept.select(F.struct("*").alias("row"), build(F.col(text_col)).alias("found"))
    return marked.select("row.*", "found.*")


EDIT = "struct<start:int,length:int,replacement:string>"


def apply_edits(trees: DataFrame, edits: Column, *, text_col: str = "text", ranks_path: str = RANKS_PATH, return_text: bool = True) -> DataFrame:
    """``trees`` after ``edits`` (array<struct<start, length, replacement>>, applied in order): text, n_tokens, leaf_chars
    and leaf_tokens are renewed; n_before and n_recounted (pre-tokens counted anew) are added.

    A null array or edit changes nothing; null fields are 0 or empty; starts and lengths are cut to the text. A null text
    is edited as an empty one. Input columns n_before and n_recounted are replaced.
    """

    @pandas_udf("text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_recounted long")
    def change(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(ranks_path)
        for texts, chars, tokens, changes in batches:
            rows = []
            for text, c, n, todo in zip(texts, chars, tokens, changes):
                tree = TokenTree.stored(text or "", c, n, count)
                for e in () if todo is None else todo:
                    if e is not None:
                        tree.edit(int(e["start"] or 0), int(e["length"] or 0), e["replacement"] or "")
                rows.append((tree.text() if return_text else None, tree.total, *tree.leaves(), tree.recounted))
            yield pd.DataFrame(rows, columns=["text", "n_tokens", "leaf_chars", "leaf_tokens", "n_recounted"])

    kept = without(in_batches(trees), ["n_before", "n_recounted"])
    rest = [F.col(c) for c in kept.columns if c not in (text_col, "n_tokens", "leaf_chars", "leaf_tokens")]
    marked = kept.select(*rest, F.col("n_tokens").alias("n_before"), change(F.col(text_col), F.col("leaf_chars"), F.col("leaf_tokens"), edits).alias("found"))
    return marked.select(*rest, "n_before", F.col("found.text").alias(text_col), "found.n_tokens", "found.leaf_chars", "found.leaf_tokens", "found.n_recounted")


def seeded_edits(id_col: str, text_col: str, n: int = 3) -> Column:
    """``n`` edits whose places, lengths and words follow from the id: what a cleaning pass does to a text."""

    def one(k: int) -> Column:
        h = F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.lit(1 << 30))
        size = F.coalesce(F.length(F.col(text_col)), F.lit(0))
        word = F.when(h % 3 == 0, "").when(h % 3 == 1, " edited text, ").otherwise(F.concat(F.lit("v"), (h % 1000).cast("string")))
        return F.struct((h % (size + 1)).cast("int").alias("start"), (h % 17).cast("int").alias("length"), word.alias("replacement"))

    return F.array(*[one(k) for k in range(n)])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after three seeded edits, and how many pre-tokens the edits recounted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    edited = apply_edits(token_trees(docs), seeded_edits("doc_id", "text"), return_text=False)
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_recounted", F.size("leaf_chars").alias("n_leaves"))

"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into equal blocks. Two fingerprints at ``distance`` bits or fewer agree in all but ``distance``
blocks, so they meet under one of the keys made of ``blocks - distance`` blocks each. Fingerprints are joined on these
keys and verified by their Hamming distance.

Equal fingerprints are folded into one class first, so a group of copies is one row. A key under which more than
``BUCKET`` fingerprints meet is not paired out. For these the join key is every fingerprint at one bit or none from the
class: at most 65 fingerprints share it, all of them within two bits of one another, and any two within two bits share
one. That is exact for a distance of two, grows linearly and needs no cap.

Texts that share four fifths of their shingles differ in 15 % of their bits. Blocks of bits that such a pair shares must be
short, and short blocks are shared by chance, by ever more pairs as the input grows. So for these (``keep_one``,
``similar_documents``) fingerprints have 1024 bits, and their blocks are made from samples of the shingles instead, which
two texts share only if they have shingles in common; the distance is verified as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from twinframe.llm.common import discard, in_batches, materialise
from twinframe.llm.components import components, with_group

BITS = 64
HASH_SEED = 42
#: Fingerprints under one key up to which they are compared pairwise.
BUCKET = 24
#: Shingles hashed before their bits are counted; bounds memory.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int = HASH_SEED) -> list[int]:
    """XXH64 of every run of ``width`` words (ASCII white space, A-Z lowered); fewer words: of all of them; none: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    return [h(line[s : e - 1], seed) for s, e in zip(starts, starts[width:])]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, lowest first, is set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text, as an unsigned integer; 0 without words."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += _bit_counts(np.array(hashes[at : at + CHUNK], np.uint64))
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_column(width: int):
    @pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return fingerprints


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(record_id, fp): the fingerprint of every row as a signed long. Null and blank texts: 0."""
    return in_batches(df).select(F.col(id_col).alias("record_id"), _fingerprint_column(width)(F.col(text_col)).alias("fp"))


def _block_keys(blocks: int, distance: int) -> list[Column]:
    """The keys of ``fp``: which blocks, and their bits."""
    size = BITS // blocks
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = reduce(lambda m, b: m | ((1 << size) - 1) << (b * size), kept, 0)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(signed)).alias("v")))
    return keys


def links(classes: DataFrame, *, blocks: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` at two bits or fewer, enough for the same components.

    Under keys of up to ``bucket`` fingerprints every pair that verifies is returned; under larger ones each fingerprint
    is linked to the least of those it shares a neighbour with.
    """
    distance = 2
    keyed = materialise(classes.select("fp", F.explode(F.array(*_block_keys(blocks, distance))).alias("key")), "simhash-blocks")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(met, "key")
    few = shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.expr(f"flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, {bucket}), b -> bit_count(a ^ b) <= {distance}), b -> struct(a as a, b as b))))")
    pairs = few.select(F.explode(near).alias("p")).select("p.a", "p.b")
    many = shared.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << BITS) * (b == BITS - 1))) for b in range(BITS)])
    stars = many.select("fp", F.explode(flips).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("bs"))
    stars = stars.filter(F.size("bs") > 1).select("a", F.explode("bs").alias("b")).filter("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of two bits or fewer, own id included.

    Null, empty and blank texts have fingerprint 0 and link like any other. A null id is never a component's name; a
    component of null ids alone has none. Repeated rows give repeated rows. No rows: none. Other columns are not carried.
    """
    prints = materialise(fingerprints(df, id_col=id_col, text_col=text_col, width=width), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("record_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = _with_name(rooted, F.min("least").alias("component_id")).select("fp", "component_id", F.col("copies").alias("n"))
    named = materialise(named, "simhash-named")
    return with_group(prints, named, "fp", prints.count()).select(F.col("record_id").alias(id_col), "fp", "component_id")


def _with_name(rooted: DataFrame, name: Column) -> DataFrame:
    """Classes with an aggregate ``name`` of their component; a component may hold most of them."""
    rooted = materialise(rooted, "simhash-rooted")
    return with_group(rooted, rooted.groupBy("root").agg(name, F.count(F.lit(1)).alias("n")), "root", rooted.count())


#: Words of a wide fingerprint; bits that may differ (similarity 0.8: 155 of 1024 differ, with a deviation of 11).
WORDS, WIDE_DISTANCE = 16, 178
#: Blocks of a wide fingerprint, and sampled shingles a block. A pair of similarity s shares a block with probability
#: 1 - (1 - s**SAMPLED)**BLOCKS: 0.99 at 0.8.
BLOCKS, SAMPLED = 20, 7
#: Shingles whose bits are counted together: as many as a byte can count.
ROWS = 255
#: Classes under one block up to which they are gathered; bounds memory, not what is compared.
TILE = 2048


def _odd(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd numbers, from the golden ratio."""
    return np.array([(0x9E3779B97F4A7C15 * (2 * k + 1 + salt)) & (2**64 - 1) | 1 for k in range(n)], np.uint64)


#: By which a hash is mixed for each word, ordered for each sample, and by which a block's samples are summed.
_MIX, _ORDERS, _SUMS = _odd(WORDS, 0), _odd(BLOCKS * SAMPLED, 1 << 20), _odd(SAMPLED, 1 << 21)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _set_bits(x: np.ndarray) -> np.ndarray:
    """How often each bit of the columns of ``x`` (n x words) is set: bytes are summed, as many rows as a byte can count."""
    counts = np.zeros(x.shape[1] * BITS, np.int64)
    for at in range(0, len(x), ROWS):
        counts += np.add.reduce(np.unpackbits(x[at : at + ROWS].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return counts


def wide_fingerprint(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(words, blocks) of a text: the ``WORDS`` x 64 bits of its SimHash, and the ``BLOCKS`` keys under which it is compared.

    A block is made from ``SAMPLED`` shingles, each the least of the text under an order of its own, so similar texts
    often draw the same. Without words: all bits 0, and no blocks.
    """
    hashes = np.array(shingle_hashes(text, width), np.uint64)
    counts, least = np.zeros(WORDS * BITS, np.int64), np.full(len(_ORDERS), ~np.uint64(0))
    for at in range(0, len(hashes), ROWS):
        x = hashes[at : at + ROWS, None]
        counts += _set_bits(_mixed(x * _MIX))
        least = np.minimum(least, (x * _ORDERS).min(axis=0))
    words = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)
    if not len(hashes):
        return words, np.zeros(0, np.uint64)
    keys = (_mixed(least).reshape(BLOCKS, SAMPLED) * _SUMS).sum(axis=1, dtype=np.uint64)
    return words, _mixed(keys + np.arange(BLOCKS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def near_rows(words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) between fingerprints (n x words) at ``distance`` bits or fewer: those of a spanning forest, so no more
    than n. Every pair is compared, but for rows that are in one component already."""
    left, rest = np.ascontiguousarray(words.T), np.arange(len(words))
    queue, a, b = [], [], []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest, left = rest[0], rest[1:], left[:, 1:]
        near = np.bitwise_count(left ^ words[at][:, None]).sum(axis=0, dtype=np.int32) <= distance
        if near.any():
            found = rest[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found)
            rest, left = rest[~near], left[:, ~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compared(members: DataFrame, group: list[str], distance: int) -> DataFrame:
    """(a, b): the links within each group of ``members`` (group columns, node, words). A group is gathered in one task, so
    its size must have a bound; groups follow one another in sorted partitions."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(key: np.ndarray, node: np.ndarray, words: np.ndarray, last: bool):
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            ends = [*starts[1:], len(key)]
            pairs = []
            for s, e in [*zip(starts, ends)][: None if last else -1]:
                a, b = near_rows(words[s:e], distance)
                pairs.append((node[s:e][a], node[s:e][b]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            out = pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            return out, (key[starts[-1] :], node[starts[-1] :], words[starts[-1] :])

        held = (np.zeros((0, len(group)), np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64))
        for batch in batches:
            if batch.num_rows:
                key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(group))])
                node = batch.column(len(group)).to_numpy(zero_copy_only=False)
                words = batch.column(len(group) + 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
                out, held = linked(*(np.concatenate(x) for x in zip(held, (key, node, words))), False)
                yield out
        if len(held[0]):
            yield linked(*held, True)[0]

    dealt = members.select(*group, "node", "words").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(compare, "a long, b long")


def wide_links(classes: DataFrame, *, distance: int = WIDE_DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): links between classes (node, words, blocks: arrays of longs) that share a block and differ in ``distance`` bits
    or fewer, enough for the same components.

    Blocks with the same classes are compared once. Up to ``tile`` classes under a block are gathered and compared whole.
    Larger blocks are compared with their least class first, where they lie: in a group of many copies that links nearly
    all. What it does not link is compared with the whole block, in tiles of two parts of it. Only links leave a tile,
    fewer than it has classes. So the work on copies is linear; on unlike classes under one block it is not, but texts that
    share a part s of their shingles meet in one only with probability s**7.
    """
    keyed = classes.select("node", F.explode(F.array_distinct("blocks")).alias("key"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("m > 1")
    met = materialise(met.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "simhash-blocks")
    members = keyed.join(met, "key").join(classes.select("node", "words"), "node")
    members = materialise(members.select("key", "m", "node", "words"), "simhash-members")
    found = _compared(members.filter(F.col("m") <= tile), ["key"], distance)
    large = members.filter(F.col("m") > tile)
    centre = large.groupBy("key").agg(F.min(F.struct("node", "words")).alias("c")).select("key", F.col("c.node").alias("c_node"), F.col("c.words").alias("c_words"))
    differ = F.expr("aggregate(zip_with(words, c_words, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    large = materialise(large.join(centre, "key").select("key", "m", "node", "words", "c_node", (differ <= distance).alias("near")), "simhash-large")
    found = found.unionAll(large.filter("near and node <> c_node").select(F.col("c_node").alias("a"), F.col("node").alias("b")))
    rest = large.filter("not near").groupBy("key").agg(F.count(F.lit(1)).alias("left_over"))
    half = max(1, tile // 2)
    parts = lambda n: F.ceil(F.col(n) / half).cast("int")
    open_ = large.join(rest, "key").withColumn("p_parts", parts("left_over")).withColumn("q_parts", parts("m"))
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    mine = open_.filter("not near").select("key", part("p_parts", "p").alias("p"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q"), "node", "words")
    every = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1)).alias("p"), part("q_parts", "q").alias("q"), "node", "words")
    found = found.unionAll(_compared(mine.unionAll(every), ["key", "p", "q"], distance))
    links = materialise(found.distinct(), "simhash-links")
    discard(met, members, large)
    return links


def _wide_classes(df: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's id, hash of its text and class; each class's least row (null ids last), words and blocks."""

    @pandas_udf("words array<long>, blocks array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = [wide_fingerprint(t if isinstance(t, str) else None, width) for t in texts]
            yield pd.DataFrame({"words": [w.view(np.int64) for w, _ in both], "blocks": [b.view(np.int64) for _, b in both]})

    text = F.col(text_col)
    rows = in_batches(df).select(F.col(id_col).alias("record_id"), F.xxhash64(text).alias("text_hash"), prints(text).alias("found"))
    rows = materialise(rows.select("record_id", "text_hash", "found.*").withColumn("node", F.xxhash64("words")), "simhash-wide")
    least = F.min(F.struct(F.col("record_id").isNull().alias("no_id"), "record_id", "text_hash")).alias("least")
    classes = rows.groupBy("node").agg(least, F.first("words").alias("words"), F.first("blocks").alias("blocks"))
    return rows, materialise(classes, "simhash-classes")


def _named(classes: DataFrame, distance: int) -> DataFrame:
    """(node, root, least): every class with its component."""
    roots = components(wide_links(classes.select("node", "words", "blocks"), distance=distance))
    return classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(id, component_id) by wide fingerprints: near copies that share about four fifths of their shingles.

    Nulls, blanks, repeated rows and empty tables as for :func:`near_duplicates`: texts without words are one class.
    """
    rows, classes = _wide_classes(df, id_col, text_col, width)
    rooted = _named(classes, distance)
    named = _with_name(rooted, F.min("least").alias("named")).select("node", F.col("named.record_id").alias("component_id"))
    named = materialise(named.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node"), "simhash-named")
    return with_group(rows.select("record_id", "node"), named, "node", rows.count()).select(F.col("record_id").alias(id_col), "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """One row of each group of near copies: that of least id, null ids last; ties: of least text hash.

    Ids may be null or repeat: a row is known by its id and text. Of rows that agree in both one stays, whichever. Texts
    without words are copies of one another. Columns are those of ``df``, whatever their names. No rows: none.
    """
    rows, classes = _wide_classes(df, id_col, text_col, width)
    kept = _named(classes, distance).groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.record_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    again = rows.groupBy(F.col("record_id").alias("r_id"), F.col("text_hash").alias("r_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = lambda i, h: F.col("k_id").eqNullSafe(F.col(i)) & (F.col("k_hash") == F.col(h))
    kept = materialise(kept.join(again, same("r_id", "r_hash"), "left").select("k_id", "k_hash", F.col("n").isNotNull().alias("repeats")), "simhash-kept")
    discard(rows, classes)
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("r_id"), F.xxhash64(F.col(text_col)).alias("r_hash"))
    out = whole.join(kept.filter(~F.col("repeats")), same("r_id", "r_hash"), "left_semi").select("row")
    many = kept.filter("repeats")
    if not many.isEmpty():
        out = out.unionAll(whole.join(many, same("r_id", "r_hash"), "left_semi").groupBy("r_id", "r_hash").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over 3-word shingles and its component at two bits or fewer."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

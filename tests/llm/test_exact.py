"""Results of the operators against brute force, SQL, libraries or exact round trips."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinframe.llm import components, jpeg, licenses, media, mixing, neighbours, pieces, queries, sharding, simhash, tokens


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))


def test_token_trees_follow_edits(texts):
    count, rng = tokens.Counter(), random.Random(1)
    whole = lambda s: len(count.encoding.encode_ordinary(s))
    pool = ["", " ", "  ", "\n\n ", "'s", "'", "re", " word", "12", "été ", "   x", "漢字", "'re", "\t"]
    some = [*list(texts.values())[:60], *["".join(rng.choices(pool, k=rng.randrange(0, 300))) for _ in range(200)]]
    for s in some:
        tree = tokens.TokenTree.build(s, count)
        assert tree.total == whole(s)
        for _ in range(5):
            a, n, new = rng.randrange(0, len(s) + 1), rng.choice([0, 1, 2, 40, 400]), "".join(rng.choices(pool, k=rng.randrange(0, 3)))
            tree.edit(a, n, new)
            s = s[:a] + new + s[a + n :]
            assert tree.text() == s and tree.total == whole(s)
        again = tokens.TokenTree.stored(s, *tree.leaves(), count)
        assert again.total == tree.total and again.text() == s


def test_edits_recount_little(spark):
    text = "some words to count, over and over. " * 4000
    df = tokens.token_trees(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    edit = F.array(F.struct(F.lit(70_000).alias("start"), F.lit(3).alias("length"), F.lit("new").alias("replacement")))
    r = tokens.apply_edits(df, edit).first()
    want = text[:70_000] + "new" + text[70_003:]
    assert r.text == want and r.n_recounted < 4 * tokens.LEAF
    assert r.n_tokens == len(tokens.Counter().encoding.encode_ordinary(want)) and sum(r.leaf_tokens) == r.n_tokens


def test_leaves_split_when_a_text_grows():
    count = tokens.Counter()
    tree = tokens.TokenTree.build("a few words", count)
    new = " and many more words" * 1250
    tree.edit(5, 0, new)
    before = tree.recounted
    tree.edit(12_000, 1, "x")
    text = "a few" + new + " words"
    text = text[:12_000] + "x" + text[12_001:]
    assert tree.text() == text and tree.total == len(count.encoding.encode_ordinary(text))
    assert tree.recounted - before < 4 * tokens.LEAF and len(tree.texts) > 5000 // tokens.LEAF


def test_token_query(spark, sf_dir, texts):
    """The registered query against whole encodings of edited texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens.seeded_edits("doc_id", "text").alias("todo"))
    edits, whole = {r.doc_id: r.todo for r in docs.collect()}, tokens.Counter().encoding.encode_ordinary
    got = queries.QUERIES["op1_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        s = texts[r.doc_id]
        assert r.n_tokens == len(whole(s))
        for e in edits[r.doc_id]:
            s = s[: e.start] + e.replacement + s[e.start + e.length :]
        assert r.n_tokens_edited == len(whole(s))


def test_pieces_query(spark, sf_dir, texts):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = queries.QUERIES["op7_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.round_trip and r.ids == ref.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)


def test_pieces_equal_the_library(texts):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    own, rng = pieces.load(pieces.MODEL_PATH), random.Random(3)
    some = [*texts.values(), *["".join(rng.choices("  ab\n\tcéß漢é1209thein.,'$*🙂\xa0", k=rng.randrange(0, 60))) for _ in range(500)]]
    assert own.kind == "bpe" and own.encode(some) == ref.encode(some)
    assert [own.decode(x) for x in own.encode(some)] == some


@pytest.mark.parametrize("bound, held", [(4, 1 << 23), (300, 1 << 23), (10**6, 100), (300, 5000)])
def test_pieces_when_little_is_remembered(monkeypatch, texts, bound, held):
    own, some = pieces.load(pieces.MODEL_PATH), [*texts.values(), None, "", "  a  b ", "\n"]
    want = own.encode(some)
    monkeypatch.setattr(pieces, "WORDS", bound)
    monkeypatch.setattr(pieces, "WORD_CHARS", held)
    own.forget()
    for n in range(0, len(some), 7):
        assert own.encode(some[n : n + 7]) == want[n : n + 7]
        assert len(own.words) == len(own.begin) == len(own.size) == len(own.uses) and own.held == sum(map(len, own.words))
    own._tidy()
    assert len(own.words) <= bound and own.held <= held
    assert own.encode([]) == [] and own.encode([None, ""]) == [[], []]


def test_pieces_decode_bytes_that_are_no_text():
    own, rng = pieces.load(pieces.MODEL_PATH), random.Random(5)
    for _ in range(1500):
        ids = [rng.choice([rng.choice(list(own.bytes_of)), rng.choice(sorted(own.special)), rng.randrange(len(own.pieces))]) for _ in range(rng.randrange(9))]
        text, run = "", b""
        for i in [*ids, None]:
            if i in own.bytes_of:
                run += bytes([own.bytes_of[i]])
            else:
                text += run.decode("utf-8", "replace") + ("" if i is None or i in own.special else own.pieces[i])
                run = b""
        text = text.replace(pieces.MARK, " ")
        assert own.decode(ids) == text.removeprefix(" ")


def test_viterbi_is_the_best_sum(texts):
    """The same pieces and scores as a unigram model, against all segmentations of short words."""
    own = pieces.load(pieces.MODEL_PATH, "unigram")
    words = sorted({w for t in texts.values() for w in re.findall(r"[a-zé]{1,9}", t)})[:400]
    for word, ids in zip(words, own.encode(words)):
        marked = pieces.MARK + word
        cuts = product([False, True], repeat=len(word))
        sums = []
        for c in cuts:
            at = [0, *[n + 1 for n, x in enumerate(c) if x], len(marked)]
            parts = [marked[i:j] for i, j in zip(at, at[1:])]
            if all(p in own.ids for p in parts):
                sums.append(sum(own.scores[own.ids[p]] for p in parts))
        assert sum(own.scores[i] for i in ids) == max(sums) and own.decode(ids) == word


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(n, near):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op6_simhash"](spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [_fingerprint(texts[i]) for i in ids]
    roots = _roots(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[r] for r in roots]


@pytest.mark.parametrize("bucket", [2, 24])
def test_links_in_large_buckets(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, bucket=bucket)).collect()}
    roots = _roots(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    groups = lambda of: {frozenset(i for i in range(len(values)) if of[i] == r) for r in of}
    assert groups([found.get(v, v) for v in signed]) == groups(roots)


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(links.unionAll(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))).collect()
    assert {r.root for r in got if r.node <= 300} == {0} and {r.root for r in got if r.node >= 900} == {900}


def test_components_of_hubs(spark):
    """Two stars whose centres are the largest and a middle node, linked by one edge, beside many pairs."""
    stars = [(9000, n) for n in range(1, 1500)] + [(n, 5000) for n in range(5001, 6500)] + [(1, 5000)]
    pairs = [(20000 + 2 * n, 20001 + 2 * n) for n in range(2000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(stars + pairs, "a long, b long")).collect()}
    want = {x: 1 for p in stars for x in p} | {x: min(p) for p in pairs for x in p}
    assert got == want


def test_with_group_is_the_join(spark):
    """Groups above and below the bound, one with a third of all rows, keys without a group and null keys."""
    rows = [(k, n) for n, k in enumerate([7] * 1500 + [*range(100, 3000)] + [8, 8, 8, -1, -1, None])]
    df = spark.createDataFrame(rows, "k long, v long")
    groups = df.filter("k >= 0").groupBy("k").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    got = components.with_group(df, groups, "k", len(rows))
    assert got.columns == ["k", "v", "least"]
    want = df.join(groups.drop("n"), "k").select("k", "v", "least")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert components.with_group(df.limit(0), groups.limit(0), "k", 0).count() == 0


def test_wide_fingerprints_find_near_copies(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    docs = []
    for n in range(60):
        words = rng.choices(vocabulary, k=300)
        docs.append((3 * n, " ".join(words)))
        for c in (1, 2):
            copy = list(words)
            for _ in range(5):
                copy[rng.randrange(300)] = "changed"
            docs.append((3 * n + c, " ".join(copy)))
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {r.doc_id for r in kept.collect()}
    # Similarity is about 0.84 here; a few copies may be missed, no original may be lost.
    assert {3 * n for n in range(60)} <= left and len(left) <= 63


def _altered(words, rng, lowest, n):
    """``words`` with ``n`` of its bits from ``lowest`` on changed."""
    flip = np.zeros(simhash.WORDS * 64, np.uint8)
    flip[rng.choice(np.arange(lowest, len(flip)), n, replace=False)] = 1
    return words ^ np.packbits(flip, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("tile", [4, 64, 2048])
@pytest.mark.parametrize("copies", [False, True])
def test_wide_links_equal_all_pairs_under_a_block(spark, tile, copies):
    """Unlike classes or many copies under one block, and small blocks besides, whatever the tile."""
    rng = np.random.default_rng(tile)
    words = rng.integers(0, 2**63, (240, simhash.WORDS), np.int64).astype(np.uint64)
    for n in range(1, 240) if copies else range(0, 240, 3):
        # Copies of one, some further from one another than allowed; or every third a copy of another, some too far.
        words[n] = _altered(words[0], rng, 0, 60 + n % 80) if copies else _altered(words[(n + 121) % 240], rng, 64, 150 + n % 50)
    blocks = [[7, 1000 + n // 5, 2000 + n // 5] for n in range(240)]
    blocks[230:] = [[3000 + n] for n in range(10)]
    df = spark.createDataFrame([*zip(range(240), words.view(np.int64).tolist(), blocks)], "node long, words array<long>, blocks array<long>")
    found = {r.node: r.root for r in components.components(simhash.wide_links(df, tile=tile)).collect()}
    roots = _roots(240, lambda i, j: bool(set(blocks[i]) & set(blocks[j])) and int(np.bitwise_count(words[i] ^ words[j]).sum()) <= simhash.WIDE_DISTANCE)
    assert [found.get(n, n) for n in range(240)] == roots
    assert 220 < 240 - len(set(roots)) if copies else 40 < 240 - len(set(roots)) < 80


def _copies(rng, vocabulary, n, words, changed):
    """A text, and ``n`` copies with ``changed`` words replaced."""
    text = rng.choices(vocabulary, k=words)
    out = [" ".join(text)]
    for _ in range(n):
        copy = list(text)
        for at in rng.sample(range(words), changed):
            copy[at] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def test_recall_of_near_copies(spark):
    """Pairs of similarity 0.8 or more by brute force, among small groups and one of far more than a tile of 32."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = [t for n in range(120) for t in _copies(rng, vocabulary, 2, rng.choice([60, 150, 400]), rng.choice([1, 2, 4]))]
    texts += _copies(rng, vocabulary, 150, 300, 3)
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    prints = [simhash.wide_fingerprint(t) for t in texts]
    df = spark.createDataFrame([(n, w.view(np.int64).tolist(), b.view(np.int64).tolist()) for n, (w, b) in enumerate(prints)], "node long, words array<long>, blocks array<long>")
    for tile in (32, 2048):
        root = {r.node: r.root for r in components.components(simhash.wide_links(df, tile=tile)).collect()}
        similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        caught = sum(root.get(i, i) == root.get(j, j) for i, j in similar)
        assert len(similar) > 2000 and caught >= 0.97 * len(similar)
        # Small groups alone, as a large group's pairs are joined by one another.
        few = [(i, j) for i, j in similar if i < 360]
        assert len(few) > 60 and sum(root.get(i, i) == root.get(j, j) for i, j in few) >= 0.9 * len(few)


def test_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    one, two, three = text(), text(), text()
    rows = [(None, one, "a"), (None, two, "b"), (None, two, "c"), (7, three, "d"), (7, three, "d"), (7, text(), "e"), (9, three, "f"), (None, None, "g"), (4, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_id string").coalesce(1)
    got = simhash.keep_one(df)
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == df.columns and sorted(str(r[:2]) for r in kept) == sorted(str(r) for r in [(None, one), (None, two), (7, three), rows[5][:2], (4, "")])


def test_bit_counts():
    x = np.random.default_rng(0).integers(0, 2**63, (77, 3), np.int64).astype(np.uint64)
    want = np.unpackbits(x.view(np.uint8).reshape(77, -1), axis=1, bitorder="little").sum(axis=0)
    got = simhash._set_bits(x)
    assert (got == want).all()


def test_shards(spark, sf_dir, texts):
    got = queries.QUERIES["op5_virtual_slots"](spark, sf_dir).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"}
    load, slots = [0] * 40, [[] for _ in range(40)]
    for r in got:
        data = texts[r.doc_id].encode()
        assert r["size"] == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(r["size"] for r in got)
    assert max(load) <= max(largest, 1.1 * sum(load) / 40)


def test_slot_maps():
    rng = random.Random(0)
    sizes = [rng.randrange(1000) for _ in range(2048)]
    first = sharding.SlotMap.initial(10, 2048)
    second = first.rebalance(sizes)
    third = second.grow(sizes)
    assert (second.version, third.version, third.shards) == (2, 3, 11)
    assert all(b == 10 for _, _, b in third.edits) and len(second.edits) < 1024
    for m in (second, third):
        load = [0] * m.shards
        for s, o in enumerate(m.owner):
            load[o] += sizes[s]
        assert max(load) - min(load) < 0.05 * sum(load) / m.shards


def test_shards_of_one_repeated_row(spark):
    """Rows that repeat both id and text are dealt over the shards like others."""
    rows = [(5, "the same text")] * 3000 + [(n, f"text {n}") for n in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_records(df, 10).collect()
    load, slots = [0] * 10, [[] for _ in range(10)]
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.position)
    assert len(got) == 4000 and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) - min(load) < 0.05 * sum(load) / 10 and max(map(len, slots)) < 600


def test_mixture(spark):
    rows = [(n, "w " * 10, "en", f"s{n % 4}") for n in range(400)] + [(1000 + n, "w " * 10, "de", "s4") for n in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"lang": {"en": 1, "de": 1}}
    out = mixing.mix(df, domain=F.lit("d"), weights=weights, budget=F.lit(1000), max_epochs=2, seed=1).collect()
    read = lambda lang: sum(r.n_tokens for r in out if r.lang == lang)
    # German can fill 200 at most; its siblings take over what is missing.
    assert read("de") == 200 and {r.epoch for r in out if r.lang == "de"} == {1, 2} and read("en") == 800
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)


def test_neighbours_in_many_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[100:110] = v[99]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, candidate_block=6, query_block=8).collect()
    w = v.astype(np.float64)
    for q in range(0, 500, 20):
        s = w @ w[q]
        want = sorted((-s[i], i) for i in range(500) if i != q)[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in want] and np.allclose([m[2] for m in mine], [-x for x, _ in want])


def test_quantisation_bounds():
    v = np.random.default_rng(3).normal(size=(50, 24))
    codes, scale, near, off = neighbours.quantise(v)
    about = neighbours._product(codes, codes) * scale[:, None] * scale
    length = np.sqrt((v**2).sum(axis=1))
    assert (np.abs(about - v @ v.T) <= near[:, None] * off + off[:, None] * length + 1e-9).all()


@pytest.mark.parametrize("kind", range(5))
def test_jpeg_coefficients_come_back(kind):
    rng = np.random.default_rng(kind)
    shapes = [(int(rng.integers(1, 5)), int(rng.integers(1, 5))) for _ in range(4)]
    n = sum(6 * a * d for a, d in shapes)
    c = [rng.integers(-128, 128, (n, 64)), np.where(rng.random((n, 64)) < 0.9, 0, rng.integers(-3, 4, (n, 64))), np.zeros((n, 64), int), rng.integers(-1, 2, (n, 64)), np.full((n, 64), -128)][kind]
    frames, got = jpeg.read(jpeg.write(c, shapes, [b""] * 4))
    assert (got == c).all()
    assert [i.shape for i in jpeg.images(frames, got)] == [(16 * d, 16 * a, 3) for a, d in shapes]


def test_jpeg_image_of_flat_blocks():
    c = np.zeros((6, 64), int)
    c[:4, 0] = 8 * 50  # luma 178 all over
    c[5, 0] = 8 * 20  # red chroma 148
    frames, got = jpeg.read(jpeg.write(c, [(1, 1)], [b""]))
    image = jpeg.images(frames, got)[0]
    assert (image == np.array([206, 164, 178])).all()


def test_jpeg_interleaved_scan_with_end_of_band_runs():
    """A file written by hand: one interleaved first pass of all DC coefficients, no restarts, AC in runs of ended bands."""
    bits, seg = [], lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    for _ in range(2):  # two units: 4 luma, 2 chroma blocks; the first of each unit rises by 1
        bits += [(1, 4, 1, 1)] + [(0, 4, 0, 0)] * 5

    def pack(codes):
        s = "".join(format(c, f"0{n}b") + (format(v, f"0{w}b") if w else "") for c, n, v, w in codes)
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")

    dc = seg(0xC4, b"\0" + jpeg._DC_TABLE)
    # AC table: code 00 for (0, 1), 01 for an end of band over 4 to 7 blocks.
    ac = seg(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + b"\x01\x20")
    sof = seg(0xC2, b"\x08" + (16).to_bytes(2, "big") + (32).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    first = seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])) + pack(bits)
    # Luma AC: block 0 has a one at place 1 and ends with a run over blocks 0-4, block 5 likewise over 5-7 plus padding.
    luma = seg(0xDA, bytes([1, 1, 0, 1, 63, 0])) + pack([(0, 2, 1, 1), (1, 2, 1, 2), (0, 2, 0, 1), (1, 2, 0, 2)])
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + sof + dc + ac + first + luma + b"\xff\xd9"
    frames, coef = jpeg.read([data])
    assert coef[:8, 0].tolist() == [1, 1, 2, 2, 1, 1, 2, 2] and coef[8:, 0].tolist() == [0] * 4
    assert coef[0, 1] == 1 and coef[5, 1] == -1 and np.abs(coef[:, 1:]).sum() == 2


def test_media_round_trip(spark, sf_dir, texts):
    for r in queries.QUERIES["op9_media"](spark, sf_dir).collect():
        data = texts[r.doc_id].encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_equal_texts_give_equal_media():
    rng = random.Random(0)
    some = ["".join(rng.choices("abc é漢\n", k=rng.randrange(900))).encode() for _ in range(20)]
    alone = [media.to_files([media.payload(s)])[0] for s in some]
    assert media.to_files([media.payload(s) for s in some]) == alone
    together = [media.feature(i) for _, i in media.from_files(alone)]
    assert together == [media.feature(media.from_files([f])[0][1]) for f in alone]


def test_templates_do_not_hold_one_another():
    for a, x in licenses.TEMPLATES:
        for b, y in licenses.TEMPLATES:
            inside, size = set(licenses.template_words(x)), len(licenses.template_words(y))
            assert a == b or len(inside & set(licenses.template_words(y))) < licenses.needed(size, licenses.THRESHOLD)


def _filled(tree, budget):
    """Budgets of a tree {name: (weight, capacity or subtree)} by filling: shares by weight, what a child cannot fill goes to
    its siblings."""

    def most(node):
        return sum(most(c) for w, c in node.values() if w > 0) if isinstance(node, dict) else node

    def give(node, amount, path, out):
        if not isinstance(node, dict):
            out[path] = amount
            return
        live, left = {k: min(most(c), amount) if w else 0 for k, (w, c) in node.items()}, min(amount, most(node))
        share, open_ = dict.fromkeys(node, 0.0), {k for k, m in live.items() if m}
        while left > 1e-9 and open_:
            total = sum(node[k][0] for k in open_)
            step = min(left, min((live[k] - share[k]) / node[k][0] for k in open_) * total)
            for k in open_:
                share[k] += step * node[k][0] / total
            left -= step
            open_ = {k for k in open_ if live[k] - share[k] > 1e-9}
        for k, (_, c) in node.items():
            give(c, share[k], (*path, k), out)

    out = {}
    give(tree, min(budget, most(tree)), (), out)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budgets_of_random_trees(spark, seed):
    """Zero weights and empty leaves at all levels; nothing that can be filled is lost."""
    rng = random.Random(seed)
    weights = {"domain": {f"d{n}": rng.choice([0, 1, 2]) for n in range(3)}, "lang": {f"l{n}": rng.choice([0, 1, 3]) for n in range(3)}, "source": {f"s{n}": rng.choice([0, 1, 1]) for n in range(3)}}
    sizes = [(d, x, s, rng.choice([0, 10, 100, 1000])) for d in weights["domain"] for x in weights["lang"] for s in weights["source"] if rng.random() < 0.7]
    tree = {}
    for d, x, s, n in sizes:
        tree.setdefault(d, (weights["domain"][d], {}))[1].setdefault(x, (weights["lang"][x], {}))[1][s] = (weights["source"][s], n)
    want = _filled(tree, 900)
    df = spark.createDataFrame(sizes, "domain string, lang string, source string, available long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, ["domain", "lang", "source"], weights, F.lit(900), 1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 3 for k in got)
    assert sum(got.values()) == round(sum(want.values()))


def test_mixture_of_one_id(spark):
    """All rows with one id, or none: the prefix still comes nearest to the budget."""
    for own in (None, 5):
        df = spark.createDataFrame([(own, "w " * 7, "en", "s0")] * 300 + [(own, "w " * 3, "en", "s0")] * 100, "doc_id long, text string, lang string, source string").repartition(5)
        out = mixing.mix(df, domain=F.lit("d"), weights={}, budget=F.lit(1000), seed=1, carry={"n": F.length("text")}).collect()
        assert 997 <= sum(r.n_tokens for r in out) <= 1003 and {r.n for r in out} <= {6, 14} and {r.epoch for r in out} == {1}


def test_quantisation_of_tiny_vectors():
    v = np.array([[5e-324, 0.0], [1e-310, -3e-311], [1e200, 1e-200]])
    codes, scale, near, off = neighbours.quantise(v)
    assert np.isfinite(near).all() and np.isfinite(off).all() and (off <= 1.01 * scale).all() and codes[0, 0] == 1


def test_license_windows_by_brute_force(spark, sf_dir):
    rng = random.Random(11)
    grant = licenses.TEMPLATES[1][1]
    wrapped = "# " + "\n# ".join(" ".join(grant.split()[n : n + 6]) for n in range(0, len(grant.split()), 6))
    scattered = " ".join(w + " x" * 40 for w in "Released under the MIT License".split())
    made = [wrapped, scattered, "word " * 3000 + wrapped + " word" * 3000, "", None, grant, "MIT " * 2000]
    for label, t in licenses.TEMPLATES * 6:
        ws = t.split()
        for _ in range(rng.randrange(3)):
            ws.pop(rng.randrange(len(ws)))
        for _ in range(rng.randrange(4)):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(["x", "\n", "the", "license"]))
        made.append(" ".join([*rng.choices(["the", "of", "software", "a"], k=rng.randrange(9)), *ws, *rng.choices(["the", "and"], k=rng.randrange(9))]))
    rows = [(n, t) for n, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    want = {}
    for r in docs.collect():
        ws = re.findall(licenses.WORD, (r.text or "").lower())
        best = {}
        for label, t in licenses.TEMPLATES:
            have, length = set(licenses.template_words(t)), licenses.window_length(t, licenses.THRESHOLD)
            if len(have & set(ws)) < licenses.needed(len(have), licenses.THRESHOLD):
                continue
            top = max((len(have.intersection(ws[s : s + length])) for s in range(len(ws))), default=0)
            if top >= licenses.needed(len(have), licenses.THRESHOLD):
                best[label] = max(best.get(label, 0), top / len(have))
        want[r.doc_id] = best
    texts = docs.selectExpr("doc_id as record_id", "coalesce(text, '') as text", "xxhash64(text) as text_key")
    got = {}
    for r in licenses.similar_windows(texts).collect():
        one = got.setdefault(r.record_id, {})
        one[r.label] = max(one.get(r.label, 0), r.containment)
    assert got == {k: v for k, v in want.items() if v}
    assert "mit" in got[0] and 1 not in got and got[2] == got[0] and got[5] == {"mit": 1.0}
    scan = {r.doc_id: r for r in licenses.license_scan(docs, blocks="windows").collect()}
    assert len(scan) == docs.count()
    for k, best in want.items():
        r = scan[k]
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | set(best)
        assert r.score == (1.0 if r.base_labels else max(best.values(), default=0.0))


def test_neighbours_send_nothing_through_the_driver(spark):
    """Queries that are repeated for many columns are not broadcast; copies, repeated ids and dimensions against brute force."""
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 12 if i % 7 else 5).astype(float).tolist()) for i in range(1200)]
    rows += [(i, rows[1][1]) for i in range(1200, 1500)] + rows[20:60:5] + [(100, rows[101][1])] * 25
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "8k")
    try:
        got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, candidate_block=8, query_block=16).collect()
    finally:
        spark.conf.unset(name)
    want = []
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:20]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("size", [1.0, 1e-310, 1e-120, 1e90, 1e150])
def test_bounds_of_tiles(size):
    rng = np.random.default_rng(6)
    for dim in (1, 3, 64, 1100):
        q, c = rng.normal(size=(40, dim)) * size, rng.normal(size=(50, dim)) * size * 10.0 ** rng.integers(-3, 4, (50, 1))
        c[:5] = q[:5]
        upper, unit = neighbours._bounds(neighbours.quantise(q), neighbours.lengths(q), neighbours.quantise(c), neighbours.lengths(c))
        assert (upper.astype("f8") * unit[:, None] >= q @ c.T).all()

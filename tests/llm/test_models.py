"""Held-out accuracy of the learned operators, and their probabilities against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from twinframe.llm import chars, language, queries, toxicity


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op8_language"](spark, sf_dir).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 30 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_out_of_place_distance():
    texts = ["the cat and the hat and that", "der hut und die katze und das", "the", "123 !?", None]

    def ranked(t):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not words:
            return []
        s = f" {' '.join(words)} "
        n = Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
        n.pop(" ")
        key = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
        return sorted(n, key=lambda g: (-n[g], key(g)))[: language.DEPTH]

    def code(g):
        return len(g) << 36 | int("".join(format(0 if c == " " else ord(c), "012b") for c in g), 2)

    by_lang = {"en": ranked(texts[0]), "de": ranked(texts[1])}
    r = language.Ranker({k: np.array([code(g) for g in v], np.uint64) for k, v in by_lang.items()})
    off, _ = r.distances(texts)
    for t, row in zip(texts, off.tolist()):
        own = ranked(t)
        want = [sum(abs(i - p.index(g)) if g in p else language.DEPTH for i, g in enumerate(own)) for p in by_lang.values()]
        assert row == want
    langs, score = r.predict(texts)
    assert langs == ["en", "de", "en", "und", "und"] and score[3] == 0


def _kneser_ney(rows):
    """The model by dictionaries: (toxic, ordinary) log-probability of a 5-gram."""
    d, n = toxicity.DISCOUNT, toxicity.ORDER
    count = [{n: Counter()}, {n: Counter()}]
    for text, y in rows:
        codes, _ = chars.coded([text])
        for i in range(len(codes) - n + 1):
            count[0 if y else 1][n][tuple(codes[i : i + n])] += 1
    for k in range(n - 1, 0, -1):
        for c in range(2):
            longer = count[c][k + 1] if k > toxicity.SHARED else {**count[0][k + 1], **count[1][k + 1]}
            count[c][k] = Counter(g[1:] for g in longer)
    letters = len(count[0][1])

    def p(c, g):
        k, h = len(g), g[:-1]
        if k == 0:
            return 1 / (letters + 1)
        own = [x for f, x in count[c][k].items() if f[:-1] == h]
        if not own:
            return p(c, g[1:])
        return max(count[c][k][g] - d, 0) / sum(own) + d * len(own) / sum(own) * p(c, g[1:])

    return lambda g: (math.log(p(0, g)), math.log(p(1, g)))


def test_kneser_ney(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcde", k=rng.randrange(2, 6))) for _ in range(40)]
    rows = [(" ".join(rng.choices(words[:30] if y else words[10:], k=20)), y) for y in (0, 1) for _ in range(15)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, y int"))
    want = _kneser_ney(rows)
    new = " ".join(rng.choices(words, k=30)) + " zzz abcab"
    logs, _ = model.logs([new])
    codes, _ = chars.coded([new])
    grams = [tuple(codes[i : i + 5]) for i in range(len(codes) - 4)]
    assert np.allclose(logs, [want(g) for g in grams], atol=2e-4)


def test_every_gram_is_kept(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(map(chr, rng.integers(97, 123, 20_000))), int(n % 10 == 0)) for n in range(36)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, y int"))
    gram = np.unique(chars.grams(*chars.coded([t for t, _ in rows]), toxicity.ORDER)[0])
    assert len(gram) > 1 << 19 and (model.seen[5].find(gram) < len(model.seen[5].values) - 1).all()
    assert (model.freed[5].find(gram >> np.uint64(chars.CODE_BITS)) < len(model.freed[5].values) - 1).all()


def test_toxic_words_are_found(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 8))) for _ in range(400)]
    rude = ["solemat", "nurtilos", "emarlun"]
    docs, labels = [], []
    for n in range(600):
        words, y = rng.choices(plain, k=rng.randrange(20, 200)), n % 5 == 0
        if y:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(rude)
        docs.append((n, " ".join(words)))
        labels.append((n, int(y)))
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(d.filter("doc_id < 400"), m))
    got = toxicity.score(d.filter("doc_id >= 400"), model).collect()
    right = [(r.toxicity >= 0.5) == (r.doc_id % 5 == 0) for r in got]
    assert sum(right) >= 0.95 * len(right)


def test_all_labelled_rows_are_counted(spark):
    rows = [(n, f"{'murk' if n % 4 == 0 else 'calm'} words of row {chr(97 + n % 26)}{chr(97 + n // 26)}zzz", int(n % 4 == 0)) for n in range(80)]
    df = spark.createDataFrame(rows, "record_id long, text string, y int")
    model, whole = toxicity.fit(df), toxicity.fit_counts(df)
    texts = [t for _, t, _ in rows]
    assert len(model.seen[5].values) == len(whole.seen[5].values) and model.weights is not None
    assert np.allclose(model.logs(texts)[0], whole.logs(texts)[0], atol=1e-5)


def test_toxicity_query(spark, sf_dir):
    got = queries.QUERIES["op2_toxicity"](spark, sf_dir).toPandas()
    assert len(got) == 200 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_features_by_brute_force(spark):
    """Means a letter, and the mean likelihood ratio of stretches, from the dictionaries' probabilities."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde", k=rng.randrange(2, 6))) for _ in range(40)]
    rows = [(" ".join(rng.choices(words[:30] if y else words[10:], k=20)), y) for y in (0, 1) for _ in range(15)]
    model, want = toxicity.fit_counts(spark.createDataFrame(rows, "text string, y int")), _kneser_ney(rows)
    texts = [" ".join(rng.choices(words, k=k)) for k in (30, 3)] + ["ab", None]
    got = model.features(texts)
    for text, row in zip(texts, got):
        codes, _ = chars.coded([text])
        logs = [want(tuple(codes[i : i + 5])) for i in range(len(codes) - 4)]
        if not logs:
            assert (row == 0).all()
            continue
        gain = [t - o for t, o in logs]
        ratios = [math.exp(sum(gain[i : i + toxicity.STRETCH])) for i in range(len(gain))]
        mean = [sum(x[k] for x in logs) / len(logs) for k in range(2)]
        assert np.allclose(row, [*mean, math.log(sum(ratios) / len(ratios))], atol=1e-3)


def test_profiles_by_brute_force(spark):
    """The most frequent n-grams of each language, and more languages than are compared at a time."""
    rng = random.Random(4)
    rows = [(f"l{n % 600}", " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 5))) for _ in range(6))) for n in range(900)] + [(None, "zzz"), ("l0", None)]
    got = language.profiles(spark.createDataFrame(rows, "lang string, text string"), depth=30)
    assert len(got) == 600
    for lang in ("l0", "l7", "l599"):
        n = Counter()
        for x, t in rows:
            if x == lang and t:
                s = f" {t} "
                n.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
        n.pop(" ")
        code = lambda g: len(g) << 36 | int("".join(format(0 if c == " " else ord(c), "012b") for c in g), 2)
        assert got[lang].tolist() == [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))[:30]]
    ranker = language.Ranker(got, 30)
    pred, _ = ranker.predict([t for _, t in rows[:40]])
    assert len(ranker.tables) == 10 and sum(p == r[0] for p, r in zip(pred, rows)) > 20


def test_letter_codes():
    codes, doc = chars.coded(["Ab,, c", "", None, "É1é"])
    by_doc = defaultdict(list)
    for c, d in zip(codes.tolist(), doc.tolist()):
        by_doc[d].append(c)
    e = ord("é")
    assert dict(by_doc) == {0: [0, 97, 98, 0, 99, 0], 1: [0], 2: [0], 3: [0, e, 0, e, 0]}

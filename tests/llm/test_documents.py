import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovework.llm import encoding, mixing, offence

has_ranks = pytest.mark.skipif(not os.path.exists(encoding.RANKS), reason="the vocabulary isn't here")
DOC = "doc_id long, text string, source string, ids string"


@has_ranks
def test_pieces_give_the_ids_of_the_whole():
    r = random.Random(1)
    words = ["alpha", "don't", "x1", "  ", "\n\n", "naïve", "日本語", "!!", "it's", "A", "9", "\t", "<|endoftext|>", "👩‍💻"]
    for _ in range(30):
        text = " ".join(r.choice(words) for _ in range(400)) + "".join(r.choice(words) for _ in range(50))
        cut = list(encoding.pieces(text, 37))
        assert "".join(cut) == text and len(cut) > 5
        enc = encoding.encoder()
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@has_ranks
def test_round_trip(spark):
    texts = [None, "", "<|endoftext|> a", "é" * 70_000, "word " * 40_000, "नमस्ते 👩‍💻", "a\r\n\x00b"]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], DOC)
    out = encoding.encode(df, out="tokens")
    back = {r["doc_id"]: r["back"] for r in encoding.decode(out, "tokens", out="back").collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    ids = {r["doc_id"]: r["tokens"] for r in out.collect()}
    assert ids[0] == ids[1] == [] and 50256 not in ids[2]


def test_poisson_counts(spark):
    r = np.random.default_rng(1)
    u = r.random(500)
    df = spark.createDataFrame([(float(x),) for x in u], "u double").select("u", mixing.poisson_count(F.col("u"), F.lit(1.3), F.lit(4)).alias("k"))
    high = spark.createDataFrame([(float(x),) for x in u], "u double").select("u", mixing.poisson_count(F.col("u"), F.lit(900.0), F.lit(1000)).alias("k"), mixing.poisson_count(F.col("u"), F.lit(0.0), F.lit(3)).alias("none"))
    rows = high.collect()
    assert [x["k"] for x in rows] == list(mixing.counts_at(u, 900.0, 1000)) and abs(np.mean([x["k"] for x in rows]) - 900) < 5 and not any(x["none"] for x in rows)
    p = np.exp(-1.3) * np.cumprod(np.concatenate(([1.0], 1.3 / np.arange(1, 6))))
    want = np.minimum(np.searchsorted(np.cumsum(p), u, side="left"), 4)
    assert [x["k"] for x in df.collect()] == list(want)


TARGET = "source string, target_share double, max_repeats int"


@has_ranks
def test_shares_and_caps(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(5, 60), s, None) for i, s in enumerate(["a"] * 900 + ["b"] * 150 + ["c"] * 40 + ["d"] * 30)]
    rows += [(5000, None, "a", None), (5001, "", "b", None), (5002, "x y", None, None), (0, rows[0][1], "a", None)]
    docs = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.0, 2)], TARGET)
    got = {x["source"]: x for x in mixing.shares(docs, targets).collect()}
    assert set(got) == {"a", "b", "c"}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4)):
        assert abs(got[s]["actual_share"] - share) < 0.01 and got[s]["most_repeats"] <= cap
    m = mixing.mixture(docs, targets)
    assert m.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    assert m.count() == m.select("doc_id", "copy").distinct().count()
    assert sorted(x[0] for x in m.select("source").distinct().collect()) == ["a", "b", "c"]


@has_ranks
def test_size_and_a_source_that_is_short(spark):
    """The wanted size is met but for a source that is at its cap, which is reported as short."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * r.randint(5, 60), "a" if i < 2000 else "b", None) for i in range(2010)], DOC)
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 2)], TARGET)
    got = {x["source"]: x for x in mixing.shares(docs, targets, size=20_000.0).collect()}
    assert abs(got["a"]["tokens"] - 12_000) < 60 and got["b"]["documents"] == 10 and got["b"]["most_repeats"] == 2 and got["b"]["tokens"] < 2 * 10 * 61
    half = {x["source"]: x["tokens"] for x in mixing.shares(docs, targets, size=10_000.0).collect()}
    assert abs(half["a"] - 6_000) < 60


@has_ranks
def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGET)
    assert mixing.mixture(docs, targets).count() == 0
    assert [(x["source"], x["actual_share"]) for x in mixing.shares(docs, targets).collect()] == [("a", 0.0)]
    assert mixing.shares(docs, targets.limit(0)).count() == 0


BAD = ["You are a useless idiot and everybody knows it.", "You are a pathetic loser and everybody knows it.", "I hope you get fired, you idiot.", "All foreigners are vermin and should leave.", "Send me your nude pictures tonight."]
GOOD = ["The caller sorts the list by size after a restart.", "The newest entry sorts the table by size for old clients.", "Kill the child process before the parent aborts.", "I was an idiot to forget the lock, sorry about that.", "The second pass reads the list twice."]


@pytest.fixture(scope="module")
def index():
    return offence.build([(b, 1) for b in BAD] * 2 + [(g, 0) for g in GOOD] * 3 + [(BAD[0] + " " + GOOD[0], 1), (GOOD[1], 1), (None, 1), ("", 0)])


def cosines(index, tokens):
    """All cosines of one list, one after the other."""
    def weights(t):
        where, what, count = index.features([t])
        df = dict(zip(index.vocabulary.tolist(), index.idf.tolist()))
        v = {w: (1 + np.log(n)) * df.get(w, index.unseen) for w, n in zip(what.tolist(), count.tolist())}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    q = weights(tokens)
    return np.array([sum(x * q.get(w, 0.0) for w, x in weights(t).items()) for t in index.tokens])


def test_nearest_by_brute_force(index):
    """Block-max pruning finds the same neighbours as all cosines, and the scores of what is passed over can't reach the threshold."""
    small = offence.Index([(t, y) for t, y in zip(index.tokens, index.label)], block=4)
    texts = [*BAD, *GOOD, "You idiot, the list is sorted by size twice.", "zzz qqq", "list", "Two of the entries are sorted and everybody knows it."]
    lists = [offence.words(offence.plain(s)) for s in texts] + [[]]
    for ix in (index, small):
        q, j, got = ix.nearest(lists)
        score, _ = ix.scores(lists)
        for k, t in enumerate(lists):
            cos = cosines(ix, t)
            want = np.sort(cos[cos > 0])[::-1][: offence.K]
            assert np.allclose(got[q == k], want, atol=1e-5)
            assert np.allclose(cos[j[q == k]], got[q == k], atol=1e-5)
            top = j[q == k]
            yes, no = (cos[top] ** 2 * ix.label[top]).sum(), (cos[top] ** 2 * (1 - ix.label[top])).sum()
            exact = yes / (yes + no + (offence.NOBODY_SHORT if len(t) < offence.LEAST else offence.NOBODY))
            assert abs(score[k] - exact) < 1e-5 if score[k] else exact < offence.THRESHOLD


def test_scores_below_the_threshold_are_exact(index):
    lists = [offence.words(offence.plain(x)) for x in (*GOOD, *BAD, "the worker is a table of rows and you are here")]
    yes, no, _ = index.masses(lists)
    exact = [y / (y + n + (offence.NOBODY_SHORT if len(t) < offence.LEAST else offence.NOBODY)) for y, n, t in zip(yes, no, lists)]
    assert index.scores(lists)[0] == pytest.approx(exact, abs=1e-12)
    assert any(0 < x < offence.THRESHOLD for x in exact)


def test_every_sentence_counts():
    """Short sentences, remarks of code, lines that only look like code, and words joined by underscores."""
    s = offence.sentences("You idiot!\nx = f(1)  # you are an idiot, go away\nYou are a worthless idiot, your parse() is vermin.\nyou_are_an_idiot\nfor (int i = 0; i < n; i++) {")
    assert s == ["you idiot!", "you are an idiot, go away", "x = f(1) # you are an idiot, go away", "you are a worthless idiot, your parse() is vermin.", "you are an idiot"]


@pytest.mark.parametrize("text", ["you are a clueless idiot and everybody knows it", "Yоu аrе а usеlеss idiоt аnd еvеrybоdy knоws it.", "Y0u 4r3 4 u53l355 1d10t 4nd 3v3ryb0dy kn0w5 1t.", "You are a useless i d i o t and everybody knows it.", "You are a useless i***t and everybody knows it.", "You are a useless id\u200biot and everybody knows it."])
def test_disguises(index, text):
    assert index.scores([index.unmask(offence.words(x)) for x in offence.sentences(text)])[0].max() >= offence.THRESHOLD


def test_documents(spark, index):
    labels = spark.createDataFrame([(b, 1, None) for b in BAD * 2] + [(g, 0, "r") for g in GOOD * 3] + [(None, 1, "r"), ("x", None, "r")], "text string, flagged int, reviewer string")
    rows = [(1, f"{GOOD[0]} {GOOD[4]}\n\n{BAD[3]} {GOOD[1]}", "s1"), (2, f"{GOOD[0]} {GOOD[3]}", "s1"), (3, None, "s1"), (4, "", None), (5, (GOOD[0] + " ") * 3000 + BAD[2], "s2"), (5, (GOOD[0] + " ") * 3000 + BAD[2], "s2")]
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id long, text string, source string, score string")
    out = {r["doc_id"]: r for r in offence.scores(docs, labels).collect()}
    assert len(out) == 5 and {i for i, r in out.items() if r["score"] >= offence.THRESHOLD} == {1, 5}
    assert "vermin" in out[1]["sentence"] and "vermin" in out[1]["example"]
    assert {r["source"]: (r["documents"], r["offending"]) for r in offence.rates(offence.scores(docs, labels)).collect()} == {"s1": (3, 1), None: (1, 0), "s2": (1, 1)}
    assert offence.scores(docs.limit(0), labels).count() == 0

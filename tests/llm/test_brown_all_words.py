"""Every training word from LEAST occurrences on is clustered, inside and outside the head, and scores follow from the classes."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm import brown_lm as b


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    weight = 1 / np.arange(1, 3001) ** 0.8
    weight /= weight.sum()
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=weight))) for i in range(400)] + [(900, None), (901, "never seen never"), (None, "w1 W1")]


def train_tokens(df):
    return sum(len(next(b.tokens([r.text or ""]))[0]) for r in df.where(~b.held_out(F.col("doc_id"))).collect())


def test_places():
    rng = np.random.default_rng(2)
    for words in (np.zeros(0, np.uint64), np.array([0, (1 << 64) - 1, 5], np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)):
        asked = np.concatenate([words, words + np.uint64(1), np.array([0, 1, (1 << 64) - 1], np.uint64)])
        rank = {int(w): i for i, w in enumerate(words)}
        assert b.Places(words).of(asked).tolist() == [rank.get(int(w), -1) for w in asked]


def model(spark, df, share):
    """Class of each clustered word by its hash, and the class bigrams, from the module's own steps."""
    train = df.where(~b.held_out(F.col("doc_id"))).select("doc_id", b.text_of().alias("text"))
    ranked = b.ranked_words(b.word_counts(train))
    top = sorted(ranked.collect(), key=lambda r: r.id)
    assert [r.id for r in top] == list(range(len(top))) and top == sorted(top, key=lambda r: (-r.n, r.word))
    total = train_tokens(df)
    head = sum(r.n * share >= total for r in top)
    words = np.array([r.word for r in top[:head]], np.int64).view(np.uint64)
    clustered = sum(r.n >= b.LEAST for r in top)
    beyond = ranked.where((F.col("id") >= head) & (F.col("n") >= b.LEAST)) if len(top) > head else None
    classes, matrix = b.exchange(b.neighbour_lists(train, words, clustered, beyond, b.buckets_of(clustered)), clustered)
    return {top[r.id].word: r.c for r in b.class_rows(classes, clustered).collect()}, matrix


@pytest.mark.parametrize("share", [100, b.SHARE])
def test_every_word_is_clustered(spark, share):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    held = {r.doc_id: r.h for r in df.select("doc_id", b.held_out(F.col("doc_id")).alias("h")).collect()}
    cut = {}
    for i, text in data:
        value, group, _, _, _ = next(b.tokens([text or ""]))
        cut[i] = list(zip(value.view(np.int64).tolist(), group.tolist(), strict=True))
    counts = collections.Counter(w for i, t in cut.items() if not held[i] for w, _ in t)
    end = int(b.END.view(np.int64))
    classes, matrix = model(spark, df, share)
    assert set(classes) == {w for w, n in counts.items() if n >= b.LEAST and w != end} and len(classes) > 10 * 40

    def of(token):
        return classes.get(token[0], token[1])

    want = np.zeros((b.GROUPS, b.GROUPS))
    ending = {w: g for t in cut.values() for w, g in t}
    for i, t in cut.items():
        for x, y in zip([(end, b.END_CLASS), *t[:-1]], t, strict=True):
            want[of(x), of(y)] += not held[i]
    assert (matrix == want).all()
    n, v = sum(counts.values()), len(counts)
    inside = want.sum(axis=0)
    size = np.zeros(b.GROUPS)
    for w in counts:
        size[of((w, ending[w]))] += 1
    prior = (inside + 1) / (inside.sum() + b.GROUPS)
    move = (want + prior) / (want.sum(axis=1, keepdims=True) + 1)
    got = b.brown_scores(df, share).collect()
    assert len(got) == len(data)
    for r in got:
        t = cut[r.doc_id]
        score = sum(
            math.log10(counts[y[0]] + 1) - math.log10(inside[of(y)] + size[of(y)] + 1) + math.log10(move[of(x), of(y)])
            for x, y in zip([(end, b.END_CLASS), *t[:-1]], t, strict=True)
        )
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w, _ in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 1) - math.log10(n + v + 1) for w, _ in t))
        assert r.score == pytest.approx(score) and r.perplexity == pytest.approx(10 ** (-score / len(t)))


def test_what_is_broadcast_changes_no_score(spark, monkeypatch):
    """A small head gives the scores of the usual one; most words leave their first class."""
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    want = sorted(b.brown_scores(df).collect(), key=str)
    for got, r in zip(sorted(b.brown_scores(df, 100).collect(), key=str), want, strict=True):
        assert got[:5] == r[:5] and got[5:] == pytest.approx(r[5:])
    train = df.select(b.text_of().alias("text"))
    ranked = b.ranked_words(b.word_counts(train))
    words = np.array([r.word for r in sorted(ranked.collect(), key=lambda r: r.id)], np.int64).view(np.uint64)
    clustered = ranked.where(F.col("n") >= b.LEAST).count()
    classes, matrix = b.exchange(b.neighbour_lists(train, words, clustered, None, 1), clustered)
    assert clustered > 1000
    found = {r.id: r.c for r in b.class_rows(classes, clustered).collect()}
    start = {i: i % b.CLASSES for i in range(clustered)}
    assert set(found) == set(start) and sum(found[i] != start[i] for i in found) > clustered / 2


def test_exchange_follows_a_plain_one(spark):
    """The classes after every round are those of one word after the other against the round's matrix."""
    df = spark.createDataFrame(rows()[:150], "doc_id long, text string").repartition(2)
    train = df.select(b.text_of().alias("text"))
    ranked = b.ranked_words(b.word_counts(train))
    words = np.array([r.word for r in sorted(ranked.collect(), key=lambda r: r.id)], np.int64).view(np.uint64)
    clustered = ranked.where(F.col("n") >= b.LEAST).count()
    lists = b.neighbour_lists(train, words, clustered, None, 1)
    rank = {int(w): i for i, w in enumerate(words[:clustered].view(np.int64))}
    plain = collections.Counter()
    for r in train.collect():
        value, group, _, _, _ = next(b.tokens([r.text]))
        code = [rank.get(w, -1 - g) for w, g in zip(value.view(np.int64).tolist(), group.tolist(), strict=True)]
        plain.update(zip([-1 - b.END_CLASS, *code[:-1]], code, strict=True))
    c = {i: i % b.CLASSES for i in range(clustered)}

    def name(x):
        return c[x] if x >= 0 else -1 - x

    for k in range(2):
        matrix = np.zeros((b.GROUPS, b.GROUPS))
        right, left = (collections.defaultdict(lambda: np.zeros(b.GROUPS)) for _ in range(2))
        for (x, y), n in plain.items():
            matrix[name(x), name(y)] += n
            right[x][name(y)] += n
            left[y][name(x)] += n
        moves = b._moves(0, 1, k)
        c = {i: b.best_class(matrix, c[i], left[i], right[i]) if moves[i] else c[i] for i in c}
        classes, _ = b.exchange(lists, clustered, k + 1)
        assert {r.id: r.c for r in b.class_rows(classes, clustered).collect()} == c

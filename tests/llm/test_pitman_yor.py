"""The Pitman-Yor model against a plain sampler, its normalisation, and that no partition count matters."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm import SF, table

from dovetail.llm import pitman_yor, seating, store
from dovetail.llm.blobs import gaps, pack, unpack, ungap
from dovetail.llm.text import mix


def corpus(seed, n, words="aaabbcdefg"):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), None) for i in range(n)]


class Plain:
    """Two levels of restaurants, each customer taken out and seated again at once in both."""

    def __init__(self, texts, discounts, strengths, seed):
        self.d, self.s, self.rng = discounts, strengths, random.Random(seed)
        self.tokens = [(u, w) for t in texts for u, w in zip([None, *t.split()], [*t.split(), None], strict=True)]
        self.v = len({w for _, w in self.tokens})
        self.leaf, self.root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.n, self.t, self.n0, self.t0 = Counter(), Counter(), 0, 0
        for u, w in self.tokens:
            self.sit(u, w)

    def p0(self, w):
        c, t = sum(self.root[w]), len(self.root[w])
        return (c - self.d[1] * t + (self.s[1] + self.d[1] * self.t0) / (self.v + 1)) / (self.s[1] + self.n0)

    def p(self, u, w):
        c, t = sum(self.leaf[u][w]), len(self.leaf[u][w])
        return (c - self.d[0] * t + (self.s[0] + self.d[0] * self.t[u]) * self.p0(w)) / (self.s[0] + self.n[u])

    def place(self, tables, d, new):
        at = self.rng.random() * (sum(tables) - d * len(tables) + new)
        for i, x in enumerate(tables):
            at -= x - d
            if at < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(self, tables):
        at = self.rng.random() * sum(tables)
        i = next(i for i, x in enumerate(np.cumsum(tables)) if at < x)
        tables[i] -= 1
        if not tables[i]:
            tables.pop(i)
            return True
        return False

    def sit(self, u, w):
        self.n[u] += 1
        if self.place(self.leaf[u][w], self.d[0], (self.s[0] + self.d[0] * self.t[u]) * self.p0(w)):
            self.t[u] += 1
            self.n0 += 1
            self.t0 += self.place(self.root[w], self.d[1], (self.s[1] + self.d[1] * self.t0) / (self.v + 1))

    def sweep(self):
        for u, w in self.tokens:
            self.n[u] -= 1
            if self.leave(self.leaf[u][w]):
                self.t[u] -= 1
                self.n0 -= 1
                self.t0 -= self.leave(self.root[w])
            self.sit(u, w)


def test_scores_agree_with_a_plain_sampler(spark):
    train = corpus(1, 40)
    probes = [(100 + i, t, None) for i, t in enumerate(["a b", "c", "g f e d", "a a a", "zzz b", ""])]
    docs = table(spark, train + probes)
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"), (F.col("doc_id") >= 100).alias("held"))
    model = pitman_yor.Model(own, pitman_yor.HOT, 2, 10, 2)
    got = {r["id"]: r["score"] for r in model.scores().collect()}
    plain = Plain([t for _, t, _ in train], model.discounts, pitman_yor.STRENGTHS, 5)
    mean = Counter()
    for number in range(340):
        plain.sweep()
        if number >= 40:
            for i, t, _ in probes:
                for j, (u, w) in enumerate(zip([None, *t.split()], [*t.split(), None], strict=True)):
                    mean[i, j] += plain.p(u, w) / 300
    for i, t, _ in probes:
        want = sum(math.log10(mean[i, j]) for j in range(len(t.split()) + 1))
        assert got[i] == pytest.approx(want, abs=0.06 * (len(t.split()) + 1))


@pytest.mark.parametrize("hot", [pitman_yor.HOT, 20])
def test_probabilities_sum_to_one(spark, hot):
    vocabulary = ["a", "b", "c", "d", "e", "f", "g", "zzz"]
    probes = [(100, f"{u} {w}", None) for u in vocabulary for w in vocabulary] + [(100, "", None)]
    docs = table(spark, corpus(2, 60) + probes)
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"), (F.col("doc_id") >= 100).alias("held"))
    model = pitman_yor.Model(own, hot, 1, 3, 4)
    assert (len(model.hot) > 0) == (hot == 20)
    score = {(r["block"], r["part"]): unpack(r["blob"])[0] for r in model.answers().collect()}
    total, pairs = Counter(), set()
    name = {}
    for r in model.of(model.first, pitman_yor.UP).orderBy("a", "b").collect():
        name[r["a"]] = np.concatenate([name.get(r["a"], np.zeros(0, np.uint64)), ungap(unpack(r["blob"])[0])])
    for r in model.of(model.first, pitman_yor.STATIC).collect():
        place, runs, what, c, blocks, sizes, *places = unpack(r["blob"])
        words, context = name[r["a"]], np.repeat(np.arange(len(runs)), runs)
        for block, gap in zip(blocks.tolist(), places, strict=True):
            for at, x in zip(np.cumsum(gap), score[block, r["a"]], strict=True):
                hot_one = int(place[context[at]])  # a split context has a part of its words in several parts
                pair = ("hot", hot_one) if hot_one else (r["a"], int(context[at])), int(words[what[at]])
                if pair not in pairs:
                    pairs.add(pair)
                    total[pair[0]] += 10 ** float(x)
    assert len(total) == 9 and len(pairs) == 81  # 7 words, an unseen one and the end, after each of them
    assert all(x == pytest.approx(1, abs=1e-5) for x in total.values())


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for n_parts, n_tasks in ((4, 2), (16, 5), (61, 1)):
        rows = pitman_yor.score_texts(docs.repartition(n_tasks), store.id_crc() % 7 == 2, n_parts=n_parts, samples=1, burn_in=0).collect()
        found.append({r["id"]: (r["score"], r["base_score"], r["n_known"]) for r in rows})
    assert found[0] == found[1] == found[2]


def test_a_split_context_scores_like_a_whole_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    split, whole = ({r["id"]: r for r in pitman_yor.score_texts(docs, store.id_crc() % 7 == 2, hot_limit=hot, samples=1).collect()} for hot in (300, pitman_yor.HOT))
    assert split.keys() == whole.keys()
    held = [i for i, r in whole.items() if r["held_out"]]
    tokens = sum(whole[i]["n_tokens"] for i in held)
    assert abs(sum(split[i]["score"] - whole[i]["score"] for i in held)) / tokens < 0.002


def test_seating_stays_whole():
    rng = np.random.default_rng(4)
    c = rng.integers(1, 400, 300)
    rest = np.sort(rng.integers(0, 40, 300))
    key = mix(np.arange(300).astype(np.uint64))
    s = seating.Seating(c, key)
    s.grow(np.full(300, 0.7), 0.6, 1)
    tables = np.bincount(rest, s.t, minlength=40).astype(np.int64)
    for salt in (100, 200):
        s.sweep(rest, tables, np.ones(40, bool), np.full(300, 0.01), np.full(300, 0.01), 0.6, 1.0, salt)
    dish = np.repeat(np.arange(300), s.c)
    assert (np.bincount(dish, s.size) == c).all() and (np.bincount(dish, s.size > 0) == s.t).all()
    assert (tables == np.bincount(rest, s.t, minlength=40)).all()
    to = rng.integers(1, 400, 300)
    t, sizes = seating.thinned(s.t, s.sizes(), to, key, 9)
    assert (np.bincount(np.repeat(np.arange(300), t), sizes, minlength=300) == np.minimum(c, to)).all() and (sizes > 0).all()


def by_hand(c, d, weights):
    """Shares of the numbers of tables of c customers: every way to open tables one after the other."""
    ways = {1: weights(0)}
    for n in range(1, c):
        ways = {t: ways.get(t - 1, 0) * weights(t - 1) / n + ways.get(t, 0) * max(n - t * d, 0) / n for t in range(1, n + 2)}
        total = sum(ways.values())
        ways = {t: x / total for t, x in ways.items()}
    return [ways[t] for t in range(1, c + 1)]


@pytest.mark.parametrize(("c", "weight", "step", "d"), [(3, 1.5, 0.0, 0.7), (90, 4.0, 0.3, 0.5), (300, 200.0, 0.0, 0.7), (1500, 6.0, 0.1, 0.8), (700, 900.0, 0.0, 0.6)])
def test_tables_of_a_whole_dish_have_their_distribution(c, weight, step, d):
    want = np.array(by_hand(c, d, lambda k: weight + step * k))
    u = (np.arange(20000) + 0.5) / 20000
    t = seating.drawn(np.full(len(u), c), np.full(len(u), weight), np.full(len(u), step), d, u)
    found = np.bincount(t, minlength=c + 1)[1:] / len(u)
    assert np.abs(found - want).max() < 1.01 / len(u)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("sweeps", [3, 16])
def test_a_sweep_seats_every_customer_of_a_large_dish_again(whole, sweeps):
    n, c, d, alone, p = 40, 3000, 0.6, 10_000, np.full(40, 0.05)
    rest, start = np.arange(n), np.full(n, c)  # all at one table, where a sweep of few customers leaves nearly all
    given = (start[:0], np.ones(n, bool)) if sweeps == 3 else (start,)  # drawn at once, or one by one, which takes more sweeps
    s = seating.Seating(start, mix(rest.astype(np.uint64)), np.ones(n, np.int64), *given)
    tables = np.full(n, alone + 1)
    for k in range(sweeps):
        s.sweep(rest, tables, np.full(n, whole), p, p, d, 1.0, 100 * k)
    assert (tables == (alone + s.t if whole else alone + 1)).all()
    u = (np.arange(1000) + 0.5) / 1000
    weight, step = (1 + d * (alone + (not whole))) * p[0], d * p[0] * whole
    want = seating.drawn(np.full(1000, c), np.full(1000, weight), np.full(1000, step), d, u).mean()
    assert s.t.mean() == pytest.approx(want, rel=0.1)


def test_gathering_a_part_holds_few_copies_of_its_pairs():
    rng, blobs, n = np.random.default_rng(3), [], 0
    for _ in range(12):  # blocks as _emitter packs them: distinct pairs in the order of context and word
        pairs = np.unique(rng.integers(0, 1 << 24, 60_000))
        context, runs = np.unique(mix((pairs >> 12).astype(np.uint64)), return_counts=True)
        word = np.concatenate([np.sort(mix(rng.choice(1 << 12, r, False).astype(np.uint64))) for r in runs])
        blobs.append(pack(gaps(context), runs.astype(np.uint32), word, np.ones(len(word), np.uint32)))
        n += len(word)
    part = pd.DataFrame({"kind": pitman_yor.STATIC, "a": 0, "b": range(len(blobs)), "blob": blobs})
    tracemalloc.start()
    try:
        out = pitman_yor._gather(4, np.zeros(0, np.uint64))(part)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    place, runs, what, c, _, size, *_ = unpack(out[out["kind"] == pitman_yor.STATIC]["blob"].iloc[0])
    assert c.sum() == n == size.sum() and runs.sum() == len(what) == len(c)
    assert peak < 60 * n

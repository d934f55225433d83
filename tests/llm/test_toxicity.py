"""The toxicity models against a plain calculation over strings, and what a fit reads."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import data_of, labelled, table

from dovetail.llm import toxicity

EDGES = re.compile("[!-/:-@\\[-`{-~\\x09-\\x0d ]+")


def tokens(text):
    return [w for w in EDGES.sub(" ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split(" ") if w]


def plain_evidence(texts, labels, asked, shares):
    """Mean log-likelihood ratios from the definition, with dictionaries of strings."""
    words, grams = [Counter(), Counter()], [Counter(), Counter()]
    for text, c in zip(texts, labels, strict=True):
        own = tokens(text)
        words[c].update(set(own))
        grams[c].update(set(zip([None, *own], own, strict=False)))

    def discount(counts):
        ones, twos = sum(v == 1 for v in counts), sum(v == 2 for v in counts)
        return min(ones / (ones + 2 * twos), 0.99) if ones else 0.5

    every, pairs = set(words[0]) | set(words[1]), set(grams[0]) | set(grams[1])
    held = {w: (w in words[0]) + (w in words[1]) for w in every}
    floor = 1 / (sum(held.values()) + len(every) + 1)
    gram_held = {g: (g in grams[0]) + (g in grams[1]) for g in pairs}
    d_shared = discount(list(gram_held.values()))
    of = lambda u: [g for g in pairs if g[0] == u]

    def word_p(w, c):
        d, total = discount(list(words[c].values())), sum(words[c].values())
        return max(words[c][w] - d, 0) / total + d * len(words[c]) / total * (held.get(w, 0) + 1 if w in held else 1) * floor

    def back(u, c):
        mine = [g for g in of(u) if grams[c][g]]
        n = sum(grams[c][g] for g in mine)
        return discount([x for x in grams[c].values()]) * len(mine) / n if n else 1.0

    def gram_p(g, c):
        own = of(g[0])
        total = sum(gram_held[x] for x in own)
        shared = (gram_held[g] - d_shared) / total + d_shared * len(own) / total * (held[g[1]] + 1) * floor
        n = sum(grams[c][x] for x in own)
        return (max(grams[c][g] - discount(list(grams[c].values())), 0) / n if n else 0) + back(g[0], c) * shared

    out = []
    for text in asked:
        own = tokens(text)
        total = 0.0
        for u, w in zip([None, *own], own, strict=False):
            r_word = word_p(w, 1) / word_p(w, 0)
            r_gram = gram_p((u, w), 1) / gram_p((u, w), 0) if (u, w) in pairs else back(u, 1) / back(u, 0)
            total += math.log(1 - sum(shares) + shares[0] * r_word + shares[1] * r_gram)
        mean = total / max(1, len(own))
        out.append(math.copysign(math.sqrt(abs(mean)), mean))
    return out


def test_evidence_is_that_of_a_plain_calculation(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e f G, h. i (j)".split()) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    labels = [int(rng.random() < 0.4) for _ in texts]
    rows = spark.createDataFrame(list(zip(labels, texts, strict=True)), "_label int, text string").repartition(3)
    model = toxicity.kneser_ney(*toxicity.counted(rows, "text"))
    asked = [*texts[:10], "a zz b", "zz zz", "", "!!! ..."]
    for shares in ((0.01, 0.003), (0.03, 0.03)):
        got = toxicity.evidence(*data_of(asked), model, (shares,))[0]
        assert got == pytest.approx(plain_evidence(texts, labels, asked, shares), rel=1e-3, abs=1e-4)


def test_copies_of_a_text_count_once(spark):
    rows = [(i, "you fool you" if i % 2 else f"some plain words here {i % 8}", None) for i in range(400)]
    docs = table(spark, rows).select("doc_id", "text")
    model = toxicity.fit(docs, labelled(spark, [(i, 1, i % 2, "") for i in range(400)]), F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, model, ["doc_id"]).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and np.mean([got[i] for i in range(1, 400, 2)]) >= np.mean([got[i] for i in range(0, 400, 2)])


def test_found_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op6_toxicity_kneser_ney(spark, sf).filter("held_out").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got}
    assert np.mean([got[i] for i, t in truth.items() if t == 1]) >= 0.9
    assert np.mean([got[i] for i, t in truth.items() if t == 0]) <= 0.01

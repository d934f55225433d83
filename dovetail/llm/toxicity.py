"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney models, of words and of bigrams of words, for toxic and for ordinary texts each, are learnt from a bounded
labelled sample (SAMPLE_PER_LABEL texts and SAMPLE_BYTES of each label; equal texts once).  Counts are the numbers of
texts that hold a word or bigram, discounted absolutely by n1 / (n1 + 2 n2) of each class and order; every seen one counts.
Both classes' words back off to shared continuation counts (how many of the classes hold a word), both classes' bigrams
to shared bigrams and these to the shared words, so an expression that is rare in one class has the same floor in both.

A toxic text is one in which a share of the tokens comes from the toxic models (SHARES: by words, by bigrams) and the rest from the
ordinary ones.  Its log-likelihood less that of an ordinary text, over the number of tokens, is a text's evidence; the
texts of a part of the sample, held out of the counts, choose the shares and fit the logistic curve that makes it a
score.  Then the counts are made of the whole sample.

Counts are made on executors; the tables that reach the driver and are sent out are bounded by the sample's bytes.

Edge cases.  Null and empty texts have the evidence 0.  Without labels of both kinds all scores are the prior (0.5
without any).  An id with differing labels has the smaller.  Repeated rows are scored each.  Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import labelled, store, vectors
from dovetail.llm.blobs import pack, tidied, tidy, unpack
from dovetail.llm.text import U64, chunks, mix, owners, words

SAMPLE_PER_LABEL, SAMPLE_BYTES = 3000, 4 << 20
#: One in so many sampled texts sets the curve and stays out of the counts meanwhile.
CALIBRATE = 4
#: Shares of a toxic text's tokens that the toxic words and bigrams give, of which the calibrating texts choose one pair.
SHARES = tuple((w, g) for w in (0.003, 0.01, 0.03) for g in (0.0003, 0.001, 0.003, 0.01, 0.03))
RIDGE = 1e-2
#: Tasks that sum the counts.
RANGES = 16
_START = U64(0x7072656365646573)
_EDGE = bytes(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Signs at the edge of a word are blanks, so that `word` and `word,` are one expression.
STRIP = np.arange(256, dtype=np.uint8)
STRIP[list(_EDGE)] = 32


def pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all tokens: the text's number, the hashes of the word before, the word, the bigram."""
    h, first = words(STRIP[data], at)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    return owners(first), before, h, mix(before * U64(3) ^ mix(h))


def once(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A place of each distinct key of each text."""
    return np.unique(mix(keys) + mix(doc.astype(U64)), return_index=True)[1]


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float = 0.0) -> np.ndarray:
    found, values = table
    if not len(found):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[at] == keys, values[at], default)


def discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return min(ones / (ones + 2 * twos), 0.99) if ones else 0.5


def _counter(batches):
    """Words and bigrams of a task's texts with their numbers of texts in both classes, for each range of keys."""
    found: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in chunks(batch.column(1)):
            doc, before, word, gram = pairs(data, at)
            y = label[lo:hi][doc]
            for kind, keys in ((0, word), (1, gram)):
                own = once(doc, keys)
                found[kind].append(_summed([(keys[own], before[own], word[own], (y[own] == 0).astype(np.uint32), (y[own] == 1).astype(np.uint32))]))
    for kind, parts in found.items():
        if parts:
            keys, *rest = _summed(parts)
            place = (keys >> U64(60)).astype(int) * RANGES // 16
            for r in np.unique(place).tolist():
                mine = place == r
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([r], pa.int32()), pa.array([pack(keys[mine], *[x[mine] for x in rest])], pa.binary())], ["kind", "r", "blob"])


def _summed(parts: list) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with their context, word and sums."""
    keys, before, word, n0, n1 = (np.concatenate([p[j] for p in parts]) for j in range(5))
    keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return keys, before[first], word[first], np.bincount(at, n0).astype(np.uint32), np.bincount(at, n1).astype(np.uint32)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(int(pdf["kind"].iloc[0]), int(pdf["r"].iloc[0]), pack(*_summed([unpack(x) for x in pdf["blob"]])))], columns=["kind", "r", "blob"])


def counted(sample: DataFrame, text_col: str) -> list[tuple[np.ndarray, ...]]:
    """(keys, context, word, texts of class 0, of class 1) of words and of bigrams."""
    rows = sample.select("_label", F.col(text_col).cast("binary")).mapInArrow(tidy(_counter), "kind int, r int, blob binary").groupBy("kind", "r").applyInPandas(tidied(_merge), "kind int, r int, blob binary").collect()
    out = []
    for kind in (0, 1):
        own = [unpack(r["blob"]) for r in sorted(rows, key=lambda r: r["r"]) if r["kind"] == kind]
        kinds = (U64, U64, U64, np.uint32, np.uint32)  # the ranges ascend and share no key
        out.append(tuple(np.concatenate([x[j] for x in own]) if own else np.zeros(0, t) for j, t in enumerate(kinds)))
    return out


def kneser_ney(of_words: tuple[np.ndarray, ...], of_grams: tuple[np.ndarray, ...]) -> dict:
    """Log ratios of toxic to ordinary probabilities: of words; of bigrams seen in either class; of the backoff in
    contexts, which unseen bigrams have."""
    keys, _, _, *n = of_words
    grams, ctx_of, word_of, *n_gram = of_grams
    n, n_gram = [x.astype(float) for x in n], [x.astype(float) for x in n_gram]
    held = (n[0] > 0).astype(float) + (n[1] > 0)
    floor = 1.0 / (held.sum() + len(keys) + 1)  # an unknown word's continuation
    p_shared = (held + 1) * floor
    contexts, at = np.unique(ctx_of, return_inverse=True)
    of_context = lambda x: np.bincount(at, x, minlength=len(contexts))
    held = (n_gram[0] > 0).astype(float) + (n_gram[1] > 0)
    d, total = discount(held), of_context(held)
    back = d * of_context(np.ones(len(grams))) / np.maximum(total, 1)
    p_gram = (held - d) / total[at] + back[at] * p_shared[np.searchsorted(keys, word_of)]
    logs = []
    for c in (0, 1):
        d, total = discount(n[c]), max(1.0, n[c].sum())
        lam = d * (n[c] > 0).sum() / total if n[c].any() else 1.0
        d_gram, n_ctx = discount(n_gram[c]), of_context(n_gram[c])
        back = np.where(n_ctx > 0, d_gram * of_context(n_gram[c] > 0) / np.maximum(n_ctx, 1), 1.0)
        own = np.maximum(n_gram[c] - d_gram, 0) / np.maximum(n_ctx, 1)[at]
        logs.append((np.log(np.maximum(n[c] - d, 0) / total + lam * p_shared), np.log(lam * floor), np.log(own + back[at] * p_gram), np.log(back)))
    ratio = [(b - a) for a, b in zip(*logs, strict=True)]
    return {"words": (keys, ratio[0].astype(np.float32)), "unknown": float(ratio[1]), "grams": (grams, ratio[2].astype(np.float32)), "contexts": (contexts, ratio[3].astype(np.float32))}


def evidence(data: np.ndarray, at: np.ndarray, model: dict, shares: tuple[tuple[float, float], ...]) -> list[np.ndarray]:
    """For each pair of shares the root (with its sign) of each text's mean log-likelihood ratio a token: near 0, where
    ordinary texts are, differences count more."""
    doc, context, word, gram = pairs(data, at)
    of_word = np.exp(look(model["words"], word, model["unknown"]))
    of_gram = look(model["grams"], gram, np.nan)
    new = np.isnan(of_gram)
    of_gram[new] = look(model["contexts"], context[new])
    of_gram = np.exp(of_gram)
    n = np.maximum(np.bincount(doc, minlength=len(at) - 1), 1)
    mean = [np.bincount(doc, np.log(1 - w - g + w * of_word + g * of_gram), minlength=len(at) - 1) / n for w, g in shares]
    return [np.sign(x) * np.sqrt(np.abs(x)) for x in mean]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float, float, float]:
    """Mean, spread, slope and height of a weighted logistic curve (Newton's steps)."""
    m, s = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([(x - m) / s, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + RIDGE * b
        b -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(2), g)
    return m, s, float(b[0]), float(b[1])


def curved(x: np.ndarray, curve: tuple[float, float, float, float]) -> np.ndarray:
    m, s, slope, height = curve
    return 1 / (1 + np.exp(-np.clip((x - m) / s * slope + height, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id") -> dict:
    sample, sizes = labelled.sample(docs, labels, label_col, allowed, SAMPLE_PER_LABEL, id_col)
    total = sum(sizes.values())
    model: dict = {"prior": sizes.get(1, 0) / total if total else 0.5}
    sample = store.materialize(sample.select("_label", id_col, text_col).dropDuplicates(["_label", text_col]), "labelled")
    n_bytes = {r[0]: r[1] or 0 for r in sample.groupBy("_label").agg(F.sum(F.octet_length(text_col))).collect()}
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    for label, size in n_bytes.items():
        if size > SAMPLE_BYTES:
            sample = sample.filter((F.col("_label") != label) | (place < SAMPLE_BYTES / size))
    apart = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(CALIBRATE)) == 0
    if len(n_bytes) < 2:
        return model
    of_words, of_grams = counted(sample.filter(~apart), text_col)
    if not of_words[3].any() or not of_words[4].any():
        return model
    model |= kneser_ney(of_words, of_grams)
    names = ", ".join(f"x{i} double" for i in range(len(SHARES)))
    held = vectors.scored(sample.filter(apart), ["_label"], text_col, lambda data, at: evidence(data, at, model, SHARES), names).collect()
    x, y = np.array([r[1:] for r in held], float).reshape(-1, len(SHARES)), np.array([r[0] for r in held], float)
    if len(set(y)) == 2:
        share = {v: sizes[v] / int((y == v).sum()) for v in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        weight = weight / weight.mean()
        curves = [logistic(x[:, i], y, weight) for i in range(len(SHARES))]
        losses = [-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-9)).sum() for p in (curved(x[:, i], c) for i, c in enumerate(curves))]
        best = int(np.argmin(losses))
        model |= kneser_ney(*counted(sample, text_col)) | {"shares": SHARES[best], "curve": curves[best]}
    else:
        model |= {"shares": SHARES[0], "curve": (0.0, 0.01, 1.0, float(np.log(max(model["prior"], 1e-6) / max(1 - model["prior"], 1e-6))))}
    return model


def classify(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of docs, score and predicted."""

    def score(data, at):
        if "curve" not in model:
            return [np.full(len(at) - 1, model["prior"])]
        return [curved(evidence(data, at, model, (model["shares"],))[0], model["curve"])]

    return vectors.scored(docs, keep, text_col, score, "score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", store.id_crc() % 5 == 0)
    model = fit(docs, store.table(spark, sf_dir, "labels"), store.id_crc() % 5 != 0)
    return classify(docs, model, ["doc_id", "held_out"])

"""Each operator against brute force on small tables, and its edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dovetail.llm import language_id, media, ngram_join, packing, pitman_yor, pivot_search, quality, secrets, sentencepiece, toxicity, vectors
from dovetail.llm.blobs import gaps, pack, ungap, unpack
from dovetail.llm.text import shingles, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, score string, predicted long, uid long, id long, _label string"
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, "One two THREE", "en"), (5, "one TWO three", "de"), (5, "one TWO three", "de"),
    (None, "no id here, at all, my friend", "en"), (6, "word " * 30000, "fr"), (7, "çé ÀA　b 漢字 🙂 \x00 <|endoftext|>", None), (8, "x" * 70000, "en"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, "s", 1, 2, 3, "l") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def data_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_blobs_round_trip():
    a, b = np.sort(np.array([5, 1 << 63, 7], np.uint64)), np.zeros(0, np.uint16)
    x, y = unpack(pack(gaps(a), b))
    assert (ungap(x) == a).all() and len(y) == 0 and y.dtype == b.dtype


def test_words_agree_with_the_pattern():
    texts = ["A b\tc", "", "  ", "ab", "AB cD\x0b x", "tail "]
    h, first = words(*data_of(texts))
    names: dict[int, str] = {}
    for i, t in enumerate(texts):
        own = WORD.findall(t.translate(LOW))
        assert first[i + 1] - first[i] == len(own)
        for x, w in zip(h[first[i] : first[i + 1]], own, strict=True):
            assert names.setdefault(int(x), w) == w
    assert len(set(names.values())) == len(names)


def test_short_texts_are_one_shingle():
    s, d = shingles(*words(*data_of(["a b", "a b c d e", "", "b a", "a b"])), 5)
    assert Counter(d.tolist()) == {0: 1, 1: 1, 3: 1, 4: 1}
    assert s[0] == s[3] != s[2]


# 1 ------------------------------------------------------------------------------------------------------------------


def test_packing_covers_every_token_once(spark, odd):
    got = packing.pack(odd, with_ids=True).collect()
    assert Counter(r["id"] for r in got).keys() == {i for i, _, _ in ODD}
    by_seq: dict[int, list] = {}
    for r in got:
        assert r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_seq.setdefault(r["sequence"], []).append(r)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 1024
    want = sorted(len(packing.encode(t)) for _, t, _ in ODD)
    assert sum(r["length"] for r in got) == sum(want)
    padding = sum(1024 - n for n in (sum(r["length"] for r in rows) for rows in by_seq.values()) if n & (n - 1))
    assert padding <= 1024 * 4


def test_packing_ids_are_those_of_the_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [x for _, x, _ in ODD if x and len(x) < 1000]
    for x in texts:
        assert packing.encode(x)[:-1].tolist() == t.encode(x, add_special_tokens=False).ids


def test_packer_fills_gaps_and_balances():
    rng = random.Random(1)
    p = packing.Packer(packing.TIERS)
    lengths = [rng.choice([3, 60, 130, 300, 700, 1500]) for _ in range(400)]
    for i, n in enumerate(lengths):
        p.add(i, n)
    p.rest()
    used = [0] * 400
    for t, window in p.windows:
        assert sum(x[0] for x in window) <= t
        for n, d, _ in window:
            used[d] += n
    assert used == lengths and sum(sum(x[0] for x in w) != t for t, w in p.windows) <= 1
    groups = Counter(packing.step_groups(p.windows, 1024, 8192).values())
    assert max(groups.values()) - min(groups.values()) <= 1


# 2 ------------------------------------------------------------------------------------------------------------------


def test_languages_on_held_out_texts(spark):
    got = language_id.op2_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(odd, none):
    model = language_id.fit(odd)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["rejected"]
    assert got[4]["lang_pred"] in ("en", "de", "fr")
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(none, model, ["doc_id"]).count() == 0


def test_language_copies_do_not_reject_what_shares_text(spark):
    rng = random.Random(4)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(1500)] for k, letters in (("de", "abcdefghiklmn"), ("fr", "hiklmnoprstuvz"))}

    def text(lang, n=150):
        return " ".join(vocabulary[lang][int(1500 * rng.random() ** 2)] for _ in range(n))

    def odd_text():
        return " ".join(rng.choice(["xqzw", "jjyx", "wvqk"]) for _ in range(150))

    shared = text("de")
    rows = [(i, text(lang), lang) for i, lang in enumerate(["de", "fr"] * 150)] + [(1000 + i, shared, "de") for i in range(200)]
    model = language_id.fit(table(spark, rows))
    unseen = [(2000 + i, shared + " " + text("de"), None) for i in range(60)] + [(3000 + i, odd_text(), None) for i in range(10)]
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, unseen), model, ["doc_id"]).collect()}
    assert model["radii"].min() > 0.1
    assert all(got[2000 + i]["lang_pred"] == "de" for i in range(60))
    assert np.mean([got[2000 + i]["rejected"] for i in range(60)]) < 0.05
    assert all(got[3000 + i]["rejected"] for i in range(10))


def test_gram_counts_stay_within_texts():
    data, at = data_of(["abc", "", "ab"])
    got = vectors.counts(data, at, np.arange(256, dtype=np.uint8), (2,), 64)
    assert got.sum(1).tolist() == [2, 0, 1]


# 3 ------------------------------------------------------------------------------------------------------------------


def test_pitman_yor_base_and_normalisation(spark):
    from dovetail.llm import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["id"]: r for r in pitman_yor.score_texts(docs, store.id_crc() % 7 == 2).collect()}
    rows = [(r["doc_id"], WORD.findall(r["text"].translate(LOW)) + [None]) for r in docs.collect()]
    c = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pitman_yor_edge_cases(odd, none):
    from pyspark.sql import functions as F

    got = pitman_yor.score_texts(odd, F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0 and r["train_tokens"] == 0 for r in got)
    got = pitman_yor.score_texts(odd, F.lit(False)).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _, _ in ODD)
    assert {r["n_tokens"] for r in got if r["id"] in (1, 2, 3)} == {1}
    assert pitman_yor.score_texts(none, F.lit(False)).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact_with_ties(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 4]) for i in range(300)]
    rows = x + [(1000 + i, x[7][1]) for i in range(40)] + [(2000, None), (2001, [1.0, float("nan")]), (2002, [None, 1.0]), (None, x[0][1]), (50, x[50][1]), (3000, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in pivot_search.top_k(docs, F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = [(i, [math.floor(256 * v) for v in e]) for i, e in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    for i, a in {i: a for i, a in q if i % 50 == 0}.items():
        each = sorted((-sum(u * v for u, v in zip(a, b, strict=True)), j) for j, b in q if j != i and len(b) == len(a))[:5]
        assert sorted(got.get(i, [])) == [(r + 1, j, -s) for r, (s, j) in enumerate(each)]
    assert pivot_search.top_k(docs.limit(0), F.col("id") % 50 == 0).count() == 0


def test_top_k_leaves_far_blocks_out(spark, monkeypatch):
    """Small blocks, so that queries meet other blocks; clustered vectors need few candidates, and results stay exact."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pivot_search, "BLOCK", 40)
    monkeypatch.setattr(pivot_search, "STEP", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (12, 16))
    clustered = centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.05, (1500, 16))
    for vectors_, most in ((clustered, 0.5), (rng.normal(0, 1, (600, 16)), 1.0)):
        docs = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(vectors_)], "vec_id long, embedding array<double>")
        rows = pivot_search.top_k(docs, F.col("id") % 50 == 0, with_evaluated=True).collect()
        whole = np.floor(vectors_ * 256).astype(np.int64)
        for i in range(0, len(whole), 50):
            each = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
            assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == i) == [(n + 1, j, -s) for n, (s, j) in enumerate(each)]
        share = np.mean([r["evaluated"] for r in rows if r["rank"] == 1]) / (len(whole) - 1)
        assert 0 < share <= most


# 5 ------------------------------------------------------------------------------------------------------------------


def best_score(model, text):
    """By trying all pieces at all positions."""
    by = {t: s for t, s in model.pieces if t}
    score = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        score[e] = max([score[e - 1] + model.floor] + [score[s] + by[text[s:e]] for s in range(max(0, e - 32), e) if text[s:e] in by])
    return score[-1]


def test_sentencepiece_finds_best_paths_and_round_trips(spark):
    import public_tokenizers

    m = sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(30).collect()] + [x for _, x, _ in ODD if x]
    for x in texts:
        assert m.decode(m.encode(x)) == x
    assert m.decode(m.encode("a▁b")) == "a b"
    for x in ["hello world", " two  spaces ", "çé漢字🙂", "aaaaabbbb", "internationalisation"]:
        marked = "▁" + x.replace(" ", "▁")
        ids = m.viterbi(marked)
        known = sum(m.pieces[i][1] for i in ids if i not in m.of_byte)
        spelt = len(bytes(m.of_byte[i] for i in ids if i in m.of_byte).decode())  # characters that no piece covers
        assert known + spelt * m.floor == pytest.approx(best_score(m, marked))
        assert m.encode(x) == ids


def test_sentencepiece_query_gives_the_ids(spark):
    import public_tokenizers

    model = sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sentencepiece.op5_sentencepiece(spark, SF).collect():
        assert len(r["ids"]) == r["n_ids"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert model.decode(r["ids"]) == (texts[r["doc_id"]] or "")


def test_sentencepiece_edge_cases(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["id"]: r for r in sentencepiece.encoded(odd, path).collect()}
    assert got[1]["n_ids"] == got[2]["n_ids"] == 0 and got[6]["n_bytes"] == 150000
    assert sentencepiece.encoded(none, path).count() == 0


# 6, 9 ---------------------------------------------------------------------------------------------------------------


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_toxicity_learns_rare_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]

    def text(toxic):
        own = [rng.choice(plain) for _ in range(80)]
        if toxic:
            for _ in range(4):
                own[rng.randrange(80)] = rng.choice(["idiot", "Clown,", "scum"])
        return " ".join(own)

    rows = [(i, text(i % 5 == 0), None) for i in range(1500)]
    docs = table(spark, rows)
    labels = labelled(spark, [(i, 1, int(i % 5 == 0), "clash") for i in range(1000)] + [(None, 1, 1, ""), (1, None, None, "")])
    model = toxicity.fit(docs.select("doc_id", "text"), labels, F.lit(True))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, model, ["doc_id"]).collect()}
    held = range(1000, 1500)
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.95


def test_toxicity_counts_words_of_few_contexts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    plain = {"en": [f"w{i}" for i in range(60)], "fr": [f"m{i}" for i in range(60)]}

    def text(lang, toxic):
        own = [rng.choice(plain[lang]) for _ in range(80)]
        if toxic:
            for _ in range(4):
                own[rng.randrange(80)] = "idiot" if lang == "en" else rng.choice(["salaud", "ordure", "minable", "abruti"])
        return " ".join(own)

    kinds = [("fr" if i % 10 == 0 else "en", i % 2 == 0 and i % 4 == 0 or i % 10 == 0 and i % 3 == 0) for i in range(1200)]
    docs = table(spark, [(i, text(*k), k[0]) for i, k in enumerate(kinds)])
    # fewer than 20 French toxic texts are labelled: each of their words has at most 20 predecessors or so
    french = [i for i, k in enumerate(kinds) if k == ("fr", True)]
    known = set(range(600)) - set(french[14:])
    labels = labelled(spark, [(i, 1, int(kinds[i][1]), "") for i in sorted(known)])
    model = toxicity.fit(docs.select("doc_id", "text"), labels, F.lit(True))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i] for i in french if i >= 600]) > 0.8
    assert np.mean([got[i] for i in range(600, 1200) if not kinds[i][1]]) < 0.02


def test_toxicity_learns_expressions_of_ordinary_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    plain = [f"w{i}" for i in range(40)]

    def text(toxic):
        own = [rng.choice(plain) for _ in range(60)]
        for _ in range(6):  # the same words in both: together in toxic texts only
            at = rng.randrange(58)
            own[at : at + 2] = ["get", "lost"] if toxic else [rng.choice(["get", "lost"]), rng.choice(plain)]
            if not toxic:
                own[rng.randrange(60)] = "get"
                own[rng.randrange(60)] = "lost"
        return " ".join(own).replace("get lost", "get lost" if toxic else "get w0")

    docs = table(spark, [(i, text(i % 3 == 0), None) for i in range(900)])
    model = toxicity.fit(docs.select("doc_id", "text"), labelled(spark, [(i, 1, int(i % 3 == 0), "") for i in range(600)]), F.lit(True))
    assert len(model["grams"][0]) > 1000
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i] == int(i % 3 == 0) for i in range(600, 900)]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_edge_cases(spark, odd, none, module):
    from pyspark.sql import functions as F

    labels = labelled(spark, [(4, 1, 0, ""), (5, 0, 1, ""), (6, 1, 0, ""), (4, 1, 0, "again"), (77, 0, 1, "no such text")])
    docs = odd.select("doc_id", "text")
    for some in (labels, labels.limit(0)):
        model = module.fit(docs, some, F.lit(True))
        got = module.classify(odd, model, ["doc_id"]).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert module.classify(none, model, ["doc_id"]).count() == 0


def test_quality_votes_are_exact(spark):
    rng = np.random.default_rng(2)
    model = {"y": rng.integers(0, 2, 50), "weight": np.ones(50), "prior": 0.5}
    near = rng.uniform(-1, 1, (20, 50))
    for row, got in zip(near, quality.vote(near, model, 7), strict=True):
        top = sorted(range(50), key=lambda i: -row[i])[:7]
        w = {i: max(row[i], 0) ** 2 for i in top}
        assert got == pytest.approx(sum(w[i] for i in top if model["y"][i]) / sum(w.values()))


def test_quality_ties_go_to_the_first_rows():
    model = {"y": np.array([1, 0, 1, 0, 0]), "weight": np.ones(5), "prior": 0.5}
    near = np.array([[0.5, 0.5, 0.5, 0.9, 0.5], [0.0, 0.0, 0.0, 0.0, 0.0], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert quality.vote(near, model, 2).tolist() == [pytest.approx(0.25 / (0.25 + 0.81)), 0.5, 0.5]
    assert quality.vote(near, model, 3)[2] == pytest.approx(2 / 3)


def test_quality_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op9_quality_knn(spark, sf).collect()}
    truth = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good = [got[i]["predicted"] for i, q in truth if q == 1 and got[i]["held_out"]]
    bad = [got[i]["predicted"] for i, q in truth if q == 0 and got[i]["held_out"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


# 7 ------------------------------------------------------------------------------------------------------------------


def by_brute_force(rows, k=5, percent=80):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOW))
        sets[n] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    first: dict[int, int] = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            first[find(n)] = min(i, first.get(find(n), i))
    return sorted(((i, len(sets[n]), first.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (None, rows[3][1]), (None, "quite another text, with enough words in it"), (5, rows[5][1]), (202, "a b"), (203, "A  b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_loses_no_link(spark, seed):
    rows = near_copies(seed)
    docs = table(spark, [(i, t, None) for i, t in rows])
    got = ngram_join.ngram_jaccard_join(docs).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == by_brute_force(rows)


def test_jaccard_join_edge_cases(odd, none):
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4), (8, 1, 8)} <= got
    assert ngram_join.ngram_jaccard_join(none).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
SECRETS = [
    (1, 'x password = "Ab3dE6gH9kL2mN" é🙂 TOKEN: abcdefgh1', "r1"), (2, "password: token: abcdefgh12", "r1"), (3, "AKIAABCDEFGHIJKL12 and AKIASHORT", "r2"),
    (4, "🙂 " + "0a" * 16 + " " + "0a" * 15, "r2"), (5, None, "r2"), (6, "", None), (7, "api_key='copied0EXAMPLE1key'", "r1"), (8, "apikey=copied0EXAMPLE1key", "r2"), (9, "secret=copied0EXAMPLE1key", "r3"),
    (1, 'x password = "Ab3dE6gH9kL2mN" é🙂 TOKEN: abcdefgh1', "r1"), (None, "passwd=Zz9yY8xX7wW6vV5", None), (10, "token=" + "0123456789abcdef" * 2, "r9"), (11, "Secret token secret=tok=en", "r1"),
]


def test_secret_spans(spark):
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s in SECRETS], "doc_id long, text string, source string, spans string")
    from pyspark.sql import functions as F

    got = secrets.scan(docs).select("row.doc_id", "row.text", secrets.joined(F.col("base")).alias("base"), secrets.joined(F.col("every")).alias("every"), secrets.redacted(F.coalesce("row.text", F.lit("")), F.col("redact")).alias("clean")).collect()
    assert len(got) == len(SECRETS)
    for r in got:
        t = r["text"] or ""
        found = [(m.start(), 0, m.end(), "assign") for m in PATTERNS["assign"].finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in PATTERNS["access"].finditer(t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in PATTERNS["hex"].finditer(t) if len(m[0]) >= 32]
        assert r["base"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        assert set(filter(None, r["base"].split(","))) <= set(r["every"].split(","))
    by = {r["doc_id"]: r for r in got}
    assert "live" in by[1]["every"] and "live" not in by[7]["every"]
    assert "Ab3dE6gH9kL2mN" not in by[1]["clean"] and by[1]["clean"].startswith('x password = "<secret>" é🙂')
    assert by[7]["clean"] == by[7]["text"] and by[10]["clean"] == "token=<secret>"
    assert secrets.scan(docs.limit(0)).count() == 0


def test_secret_spans_of_very_many_matches(spark):
    from pyspark.sql import functions as F

    text = "".join(f"é{'x' * (i % 5)} token=value{i:05d} " for i in range(300))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    got = secrets.scan(docs).select(secrets.joined(F.col("base")).alias("base")).first()["base"]
    assert got == ",".join(f"assign:{m.start()}:{m.end()}" for m in PATTERNS["assign"].finditer(text))


def test_secret_ownership_by_two_columns(spark):
    """Live are long varied values that one owner has, in any number of repositories; examples have three of either."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    values = ["Ab3dE6gH9kL2mN", "Zz9yX8wV7uT6sR", "short1aa", "aaaaaaaaaaaa1A", "Qw3rTy7uI9oP1a", "Mn8bVc6xZ4lK2j"]
    rows = [(i, f"token={rng.choice(values)} and secret: {rng.choice(values)}", rng.choice(["r1", "r2", "r3", "r4", None]), rng.choice(["me", None]) if i % 2 else "me") for i in range(14)]
    rows += [(50, f"password={values[4]}", "r9", "you"), (51, f"password={values[4]}", "r9", "they"), (52, "passwd=Only1OwnerHere9", "r5", "me"), (53, "passwd=Only1OwnerHere9", "r6", "me")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, owner string")
    found = {}
    for i, t, repo, owner in rows:
        for m in PATTERNS["assign"].finditer(t):
            if len(m[2]) >= 8:
                found.setdefault(m[2], (set(), set()))
                found[m[2]][0].add(repo)
                found[m[2]][1].add(owner)
    got = secrets.scan(docs, repo_col="a.b", owner_col="owner").select("row.doc_id", secrets.joined(F.col("every")).alias("every"), secrets.redacted(F.col("row.text"), F.col("redact")).alias("clean")).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want, clean = set(), text[r["doc_id"]]
        for m in PATTERNS["assign"].finditer(clean):
            v = m[2]
            if len(v) >= 8:
                want.add(f"assign:{m.start()}:{m.end()}")
                if len(found[v][1]) <= 1 and len(v) >= 12 and len(set(v)) >= 8 and re.search("[A-Za-z]", v) and re.search("[0-9]", v):
                    want.add(f"live:{m.end() - len(v)}:{m.end()}")
        assert set(r["every"].split(",")) == want
        for v, (repos, owners) in found.items():
            if max(len(repos), len(owners)) < 3:
                clean = clean.replace(v, "<secret>")
        assert r["clean"] == clean


# 10 -----------------------------------------------------------------------------------------------------------------


def test_media_round_trip(odd, none):
    import hashlib

    got = {r["id"]: r for r in media.media_column(odd).collect()}
    for i, t, _ in ODD:
        raw = media.padded((t or "").encode())
        r = got[i]
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-32:]) and r["n_bytes"] == len((t or "").encode())
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and len(r["rgb"]) == r["height"] * r["width"] * 3
    assert media.media_column(none).count() == 0


class Writer:
    """A plain bit-by-bit progressive encoder with fixed tables of 8-bit codes, to test the decoder with."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def signed(self, v):
        n = abs(v).bit_length()
        if n:
            self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        return media.entropy(np.array(self.bits, np.uint8))


def shifted(v, low):
    return v >> low if v >= 0 else -(-v >> low)


def test_decoder_reads_general_progressive_files():
    import struct

    rng = np.random.default_rng(4)
    height, width = 21, 35
    comps = {1: (2, 2), 2: (1, 1), 3: (1, 1)}
    rows, cols = -(-height // 16), -(-width // 16)
    coefs = {}
    for n, (h, v) in comps.items():
        c = np.where(rng.random((rows * v * cols * h, 64)) < 0.15, rng.integers(-40, 41, (rows * v * cols * h, 64)), 0)
        c[:, 0] = rng.integers(-200, 200, len(c))
        coefs[n] = c
    grid = {n: (-(-(-(-height * v // 2)) // 8), -(-(-(-width * h // 2)) // 8), cols * h) for n, (h, v) in comps.items()}
    for n, (r, k, across) in grid.items():  # blocks outside a component's own grid have DC only
        inside = np.zeros(len(coefs[n]), bool)
        inside[(np.arange(r)[:, None] * across + np.arange(k)).reshape(-1)] = True
        coefs[n][~inside, 1:] = 0
    symbols = sorted({r << 4 | s for r in range(16) for s in range(11)})
    code = {s: i for i, s in enumerate(symbols)}
    dht = lambda k: media.segment(0xC4, bytes([k, *[0] * 7, len(symbols), *[0] * 8]) + bytes(symbols))
    quant = rng.integers(1, 9, 64)
    out = [b"\xff\xd8", media.segment(0xDB, b"\0" + bytes(quant.tolist())), media.segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), dht(0), dht(0x10)]
    units = [(n, (m // cols * v + y) * cols * h + m % cols * h + x) for m in range(rows * cols) for n, (h, v) in comps.items() for y in range(v) for x in range(h)]
    w, last = Writer(), dict.fromkeys(comps, 0)
    for n, b in units:
        v = int(coefs[n][b, 0]) >> 1
        d, last[n] = v - last[n], v
        w.put(code[abs(d).bit_length()], 8)
        w.signed(d)
    out += [media.scan_head([1, 2, 3], 0, 0, 0, 1), w.done()]
    w = Writer()
    for n, b in units:
        w.put(int(coefs[n][b, 0]) & 1, 1)
    out += [media.scan_head([1, 2, 3], 0, 0, 1, 0), w.done()]
    for n, (r, k, across) in grid.items():
        blocks = [y * across + x for y in range(r) for x in range(k)]
        for start, end in ((1, 5), (6, 63)):
            w, run = Writer(), 0

            def flush():
                nonlocal run
                if run:
                    m = run.bit_length() - 1
                    w.put(code[m << 4], 8)
                    w.put(run - (1 << m), m)
                    run = 0

            for b in blocks:
                zeros, wrote_all = 0, False
                for j in range(start, end + 1):
                    v = shifted(int(coefs[n][b, j]), 1)
                    if not v:
                        zeros += 1
                        continue
                    flush()
                    while zeros > 15:
                        w.put(code[0xF0], 8)
                        zeros -= 16
                    w.put(code[zeros << 4 | abs(v).bit_length()], 8)
                    w.signed(v)
                    zeros, wrote_all = 0, j == end
                if not wrote_all:
                    run += 1
            flush()
            out += [media.scan_head([n], start, end, 0, 1), w.done()]
        w, run, pending = Writer(), 0, []
        def flush_refine():
            nonlocal run, pending
            if run:
                m = run.bit_length() - 1
                w.put(code[m << 4], 8)
                w.put(run - (1 << m), m)
                for bit in pending:
                    w.put(bit, 1)
                run, pending = 0, []

        for b in blocks:
            row = [int(x) for x in coefs[n][b]]
            new = [j for j in range(1, 64) if abs(row[j]) == 1]
            zeros, own = 0, []
            for j in range(1, (max(new) if new else 0) + 1):
                if abs(row[j]) > 1:
                    own.append(abs(row[j]) & 1)
                    continue
                if abs(row[j]) == 0:
                    zeros += 1
                    if zeros == 16:
                        flush_refine()
                        w.put(code[0xF0], 8)
                        for bit in own:
                            w.put(bit, 1)
                        zeros, own = 0, []
                    continue
                flush_refine()
                w.put(code[zeros << 4 | 1], 8)
                w.put(int(row[j] > 0), 1)
                for bit in own:
                    w.put(bit, 1)
                zeros, own = 0, []
            if (max(new) if new else 0) < 63:
                run += 1
                pending += own + [abs(row[j]) & 1 for j in range((max(new) if new else 0) + 1, 64) if abs(row[j]) > 1]
        flush_refine()
        out += [media.scan_head([n], 1, 63, 1, 0), w.done()]
    data = b"".join([*out, b"\xff\xd9"])
    frame = media.read(data)
    for p in frame["parts"]:
        assert (p["c"] == coefs[p["name"]]).all()
    image = media.rgb(frame)
    assert image.shape == (height, width, 3)
    # the inverse transform by its definition, at one luma block and without chroma rounding
    c = np.zeros((8, 8))
    c.reshape(-1)[media.ZIGZAG] = coefs[1][0] * quant
    s = lambda u: math.sqrt(0.5) if u == 0 else 1
    want = np.array([[sum(s(u) * s(v) * c[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for x in range(8)] for y in range(8)])
    got = (frame["parts"][0]["c"][0] * frame["quant"][0]) @ media.INVERSE + 128
    assert np.abs(got.reshape(8, 8) - want).max() < 0.01


def test_decoder_refuses_damage():
    whole = media.encode_payload(media.padded(b"some text"))
    for bad in (b"", b"nonsense", whole[: len(whole) // 2]):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)

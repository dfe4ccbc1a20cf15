from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from common import corpus, documents, empty, sentence
from pyspark.sql import functions as F

from rooftide.llm import language_id, subword_lm, toxicity
from rooftide.llm._common import held, word_hashes


def brute_marginal(pieces, scores, word):
    """All segmentations, one by one."""
    text = b" " + word

    def go(at):
        if at == len(text):
            return 1.0
        total = math.exp(scores[text[at]]) * go(at + 1)
        for piece, place in pieces.items():
            if text.startswith(piece, at):
                total += math.exp(scores[place]) * go(at + len(piece))
        return total

    return math.log(go(0))


TEXTS = [b" a", b" ab", b"b", b"ab", b"ba", b" b", b"bab"]
NAMED = {t: 256 + i for i, t in enumerate(sorted(TEXTS))}


def small_pieces():
    return subword_lm.make_pieces({t: -1.0 - 0.3 * i for i, t in enumerate(TEXTS)})


def test_pieces_are_a_distribution():
    pieces = small_pieces()
    assert np.exp(pieces.scores).sum() == pytest.approx(1) and len(pieces.scores) == 256 + len(TEXTS)
    with pytest.raises(FileNotFoundError, match="score_documents"):
        subword_lm.load_pieces("/nowhere/at/all.model")


def test_lattice_sums_all_segmentations():
    pieces = small_pieces()
    words = [b"a", b"ab", b"abab", b"babab", b"xyz", b"abxab"]
    got = subword_lm.lattice_scores([pieces], words)[0]
    assert got == pytest.approx([brute_marginal(NAMED, pieces.scores, w) for w in words], rel=1e-4)


def test_lattice_of_the_whole_vocabulary():
    pieces = subword_lm.load_pieces()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=subword_lm.VOCABULARY)
    texts = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    named = {t: 256 + i for i, t in enumerate(sorted(t for t in texts if len(t) <= subword_lm.LONGEST and b" " not in t[1:]))}
    for word in (b"the", b"banana", "été".encode(), b"zq"):
        inside = {t: p for t, p in named.items() if t in b" " + word}
        assert subword_lm.lattice_scores([pieces], [word])[0, 0] == pytest.approx(brute_marginal(inside, pieces.scores, word), rel=1e-4)


def test_expected_counts_add_up():
    counts = subword_lm.expected_counts(small_pieces(), [b"abab", b"xyz"])
    sizes = np.concatenate([np.ones(256), [len(t) for t in NAMED]])
    assert counts @ sizes == pytest.approx(len(b" abab") + len(b" xyz"), rel=1e-4)


def test_scores_match_brute_force(spark, monkeypatch):
    """Both scores of whole documents, each word by all of its segmentations."""
    monkeypatch.setattr(subword_lm, "load_pieces", lambda path: small_pieces())
    monkeypatch.setattr(subword_lm, "BUNDLE_BYTES", 40)
    monkeypatch.setattr(subword_lm, "ROUNDS", 0)
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abx") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 9))), "uv"[i % 2] if i % 5 else None) for i in range(40)]
    rows += [(50, None, "u"), (51, "AB ab\x0bBA", None), (None, "ab", "u"), rows[3]]
    out = lambda i: i is not None and i % 4 == 1
    got = {(r.doc_id, r.held_out): (r.score, r.mixture_score) for r in subword_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 4 == 1).collect()}
    pieces = small_pieces()
    tokens = [((t or "").lower().encode().split(), lang, out(i)) for i, t, lang in rows]
    counts = {k: Counter(w for ws, lang, held_out in tokens if not held_out and (k == "all" or lang == k) for w in ws) for k in ("all", "u", "v", None)}
    ends = {k: sum(not h and (k == "all" or lang == k) for _, lang, h in tokens) for k in counts}
    n = {k: sum(c.values()) + ends[k] for k, c in counts.items()}
    v = {k: len(c) + 1 for k, c in counts.items()}
    p_end = (ends["all"] + 1) / (n["all"] + 2)
    own = pieces.scores + math.log(1 - p_end)
    for (i, _, _), (words, _, held_out) in zip(rows, tokens, strict=True):
        want = math.log(p_end) + sum(brute_marginal(NAMED, own, w) for w in words)
        mixed = 0.0
        for k in ("u", "v", None):
            p = ends[k] / ends["all"] * ends[k] / (n[k] + v[k])
            for w in words:
                whole = (counts["all"][w] + v["all"] * math.exp(brute_marginal(NAMED, pieces.scores, w))) / (n["all"] + v["all"])
                p *= (counts[k][w] + v[k] * whole) / (n[k] + v[k])
            mixed += p
        assert got[i, held_out] == pytest.approx((want / math.log(10), math.log10(mixed)), rel=1e-3)


def test_lm_contract(spark):
    rows = corpus()
    got = {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)): r.score for r in subword_lm.score_documents(documents(spark), held("doc_id", 7, 2)).collect()}
    import zlib

    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, out(i), [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    counts = Counter(t for _, h, ts in tokens if not h for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = {(i, h, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, h, ts in tokens}
    assert set(got) == want
    assert all(s < 0 and math.isfinite(s) for s in got.values())
    assert subword_lm.score_documents(empty(spark), F.lit(False)).count() == 0


def test_lm_prefers_its_language_and_order_does_not_matter(spark):
    rng = random.Random(0)
    rows = [(i, sentence(rng, "en", 40)) for i in range(80)]
    rows += [(100, "the house of the river"), (101, "river the of house the"), (102, "qzx vvkq wwj xxz kkq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in subword_lm.score_documents(df, F.col("doc_id") >= 100, lang_col=None).collect()}
    assert got[100] == pytest.approx(got[101], abs=1e-3) and got[100] > got[102] + 5
    known = {r.doc_id: r.mixture_score - r.score for r in subword_lm.score_documents(df, F.col("doc_id") >= 100, lang_col=None).collect()}
    assert known[100] > known[102]
    none = {r.doc_id: r.score for r in subword_lm.score_documents(df, F.lit(True), lang_col=None).collect()}
    assert all(math.isfinite(x) for x in none.values())


def test_word_hashes_follow_words():
    texts = [b"a bb  a\n", b"", b" ", b"bb\x0ca ", b"abcdef abcdxx"]
    h, n = word_hashes(texts, (4,))
    assert n.tolist() == [3, 0, 0, 2, 2]
    assert h[0, 0] == h[2, 0] == h[4, 0] and h[1, 0] == h[3, 0] != h[0, 0] and h[5, 1] == h[6, 1] and h[5, 0] != h[6, 0]


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, ("en", "fr")[i % 2], rng.randrange(5, 60)), ("en", "fr")[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, ~held("doc_id", 3, 1))
    got = language_id.identify(df, model, ("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "日本語" * 50), (5, "the house")], "doc_id long, text string")
    odd = {r.doc_id: r for r in language_id.identify(odd.withColumn("score", F.lit(1)), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(odd[i].rejected and odd[i].score == 0 for i in (1, 2, 3))
    assert odd[4].lang_pred in ("en", "fr") and odd[5].lang_pred == "en"
    assert language_id.identify(empty(spark), model).count() == 0
    nothing = language_id.fit(empty(spark), F.lit(True))
    assert language_id.identify(df, nothing).first().rejected


def plain_grams(text):
    """Counts of features by the definition: 2-grams and 3-grams of bytes at every place of the text between spaces."""
    low = (text or "").lower().encode()
    data = bytes([0x20, *(c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in low), 0x20, 0x20])
    out = Counter()
    for i in range(len(low) + 1):
        a, b, c = data[i : i + 3]
        if (a, b) != (0x20, 0x20):
            out[((a << 8 | b) * 0x9E3779B1 % 2**32) >> 20] += 1
            out[((a << 16 | b << 8 | c) * 0x85EBCA77 % 2**32) >> 20] += 1
    return out


def test_language_id_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 300)
    df = documents(spark).withColumn("score", F.lit("clash")).withColumn("REJECTED", F.lit(1))
    model = language_id.fit(df, ~held("doc_id", 3, 1))
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language_id.identify(df, model, ("doc_id", "source", "score", "REJECTED")).collect())
    want = Counter()
    for i, text, *_ in corpus():
        grams = plain_grams(text)
        v = {f: math.log1p(n) * float(model.idf[f]) for f, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        near = [sum(x * float(c[f]) for f, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(near)), key=lambda k: (near[k], -k))
        wordless = not any(map(str.isalpha, text or ""))
        want[i, "und" if wordless else model.languages[best], round(0.0 if wordless else min(max(near[best], 0), 1), 4)] += 1
    assert sum((got - want).values()) <= 1  # a figure on the border of rounding


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    """One id, one row and null ids in a third of the rows each: samples neither miss them nor are filled by them."""
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    monkeypatch.setattr(language_id, "SAMPLE_EACH", 20)
    rng = random.Random(8)
    rows = [(7, sentence(rng, "en", 20), "en") for _ in range(300)] + [(8, "the same row each time", "en")] * 300 + [(None, sentence(rng, "fr", 20), "fr") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert set(model.languages) == {"en", "fr"}
    got = language_id.identify(df, model, ("lang",)).collect()
    assert len(got) == 900 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_limits_of_thin_classes_are_those_of_the_nearest():
    counted = np.zeros((language_id.CLASSES, language_id.BINS))
    counted[5, 400], counted[9, 700], counted[7, 100] = 500, 500, 3
    limits = language_id._limits(counted)
    noise = lambda c: language_id.REJECT_MARGIN + language_id.REJECT_NOISE * 2 ** (-c / 2)
    assert limits[7] == pytest.approx(0.7 - noise(7)) and limits[6] == pytest.approx(max(0, 0.4 - noise(6))) and limits[15] == pytest.approx(0.7 - noise(15))
    assert not language_id._limits(np.zeros_like(counted)).any()


def test_rejection_by_distance(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, "en", 40), "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    far = spark.createDataFrame([(1, "zxqj wvkk pprq " * 20), (2, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in language_id.identify(far, model).collect()} == {1: True, 2: False}


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = sentence(rng, "en", rng.randrange(20, 80)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["awfulx", "nastyx", "grossx"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, ~held("doc_id", 5, 0))
    got = toxicity.score(docs, model, lang_col="lang").join(marks, "doc_id").where(held("doc_id", 5, 0)).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (2, "", "xx"), (3, "word " * 50_000, "en")], "doc_id long, text string, lang string")
    found = toxicity.score(odd, model, lang_col="lang").collect()
    assert len(found) == 4 and len({r.score for r in found if r.doc_id < 3}) == 1
    assert toxicity.score(empty(spark), model).count() == 0
    one = toxicity.fit(docs, marks.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, one).where("predicted = 1").count() == 0
    assert toxicity.fit(empty(spark), marks.limit(0), F.lit(True)).out[-1] < 0
    assert toxicity.calibrate(empty(spark), marks.limit(0), F.lit(True), one).thresholds == {}


def plain_score(model, text):
    """The classifier by its definition, window by window."""
    ids, _ = toxicity.words([(text or "").encode()])
    pad = max(toxicity.WIDTHS)
    x = [sum(model.embeddings[i] for i in w) for w in ids] + [model.embeddings[0] * toxicity.PARTS] * (pad + pad)
    tops = []
    for w, f in zip(toxicity.WIDTHS, model.filters, strict=True):
        acts = [sum(x[at + j] @ f[j] for j in range(w)) for at in range(len(ids) + pad)]
        tops += list(np.max(acts, axis=0))
    hidden = np.maximum(np.array(tops) + model.biases, 0)
    a, b = model.shift
    return 1 / (1 + math.exp(-(a * (hidden @ model.out[:-1] + model.out[-1]) + b)))


def test_toxicity_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 50)
    docs = documents(spark).where("doc_id <> 58 OR doc_id IS NULL").selectExpr("*", "1 AS score", "'x' AS flagged")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(58)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~held("doc_id", 5, 0))
    got = toxicity.score(docs, model, ("doc_id", "score", "flagged", "text")).collect()
    assert got and all(r.score == pytest.approx(plain_score(model, r.text), rel=1e-3, abs=1e-5) for r in got)


def test_thresholds_by_language_are_of_least_error(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.zeros((toxicity.BUCKETS, toxicity.SIZE), np.float32), [np.zeros((w, toxicity.SIZE, toxicity.FILTERS), np.float32) for w in toxicity.WIDTHS], np.zeros(24, np.float32), np.zeros(25, np.float32))
    # Embeddings that make the score follow one word's presence.
    model.embeddings[toxicity.words([b"bad"])[0][0, 0]] = 1
    model.filters[0][0, 0, 0] = 1
    model.out[0], model.out[-1] = 2.0, -1.0
    rows = [(i, "bad" if i % 3 == 0 else "good", ("en", "fr", "xx")[i % 2 if i < 190 else 2], int((i % 3 == 0) != (rng.random() < 0.1))) for i in range(200)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = toxicity.calibrate(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"), F.lit(True), model)
    assert set(model.thresholds) == {"en", "fr"}  # too few rows of the third
    for lang, limit in model.thresholds.items():
        own = [(1 / (1 + math.exp(-1.0)) if r[1] == "bad" else 1 / (1 + math.exp(1.0)), r[3]) for r in rows if r[2] == lang]
        errors = lambda t: sum((s >= t) != y for s, y in own)
        assert errors(limit) == min(errors(t / 1000) for t in range(1001))

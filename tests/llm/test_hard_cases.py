"""Cases that all operators share: very long texts; and checks of single steps against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ethospark.llm import decontaminate, divergence, licences, line_dedup, minhash, resample, secrets, shingles, simhash, style_tree, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{i % 997} is part {i}." for i in range(30_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    rnd = random.Random(1)
    edited = LONG.split(" ")
    for _ in range(20):
        edited[rnd.randrange(len(edited))] = "changed"
    lines = "\n".join(LONG[k : k + 900] for k in range(0, len(LONG), 900))
    rows = [(1, LONG), (2, " ".join(edited)), (3, "short"), (4, None), (5, "x" * 400_000), (6, lines), (None, LONG[:300_000])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")


def test_long_texts_pass_the_operators(spark, long_docs):
    docs = long_docs
    assert len(LONG) > 500_000
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[1] == near[2] == 1 and near[5] == 5 and len(near) == 7
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}
    assert found[1] == found[2] == 1 and found[5] == 5
    prints = {r["doc_id"]: r for r in minhash.fingerprints(docs).collect()}
    assert prints[1]["n_chars"] == len(LONG) and prints[5]["n_chars"] == 400_000
    item = " ".join(LONG.split(" ")[60_000:60_030])
    items = spark.createDataFrame([(1, item), (2, "z" * 3_000)], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    assert (1, 1) in hits and not any(i == 2 for _, i in hits)
    assert resample.resample(docs, items).count() == 7 and secrets.find(docs).count() == 7
    assert divergence.audit(docs, least=2).where("part = 'pair'").count() == 0
    pages = spark.createDataFrame([(1, "http://a/", f"<article><p>{LONG}</p></article>"), (2, "http://a/", "<div>" * 3000 + "deep"), (3, "http://a/", "<" * 100_000)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    assert texts[1] == LONG and texts[2] == "deep"


def test_gradient_of_the_ordinal_likelihood():
    rnd = np.random.default_rng(4)
    z, y, theta = rnd.normal(size=40), rnd.integers(0, 4, 40), np.array([-0.5, 0.3, 1.2])
    loss, dz, dtheta = toxicity._likelihood(z, y, theta)
    cdf = lambda x: 1 / (1 + np.exp(-x))
    plain = 0.0
    for a, g in zip(z, y, strict=True):
        above = lambda k, a=a: 1.0 if k == 0 else 0.0 if k == 4 else cdf(a - theta[k - 1])
        plain -= np.log(above(g) - above(g + 1)) / len(z)
    assert abs(loss - plain) < 1e-12
    h = 1e-6
    for i in range(len(z)):
        up, down = z.copy(), z.copy()
        up[i] += h
        down[i] -= h
        assert abs((toxicity._likelihood(up, y, theta)[0] - toxicity._likelihood(down, y, theta)[0]) / (2 * h) - dz[i]) < 1e-7
    for k in range(3):
        up, down = theta.copy(), theta.copy()
        up[k] += h
        down[k] -= h
        assert abs((toxicity._likelihood(z, y, up)[0] - toxicity._likelihood(z, y, down)[0]) / (2 * h) - dtheta[k]) < 1e-7


def test_grades_are_quantiles_of_markers():
    rnd = random.Random(5)
    features, toxic = [], []
    for i in range(120):
        bad = i % 3 == 0
        own = {rnd.randrange(50, 90) for _ in range(6)} | ({rnd.randrange(0, 30) for _ in range(rnd.randrange(1, 9))} if bad else set())
        features.append(np.array(sorted(own)))
        toxic.append(int(bad))
    got = toxicity.grades(features, np.array(toxic), 3, 5, 0.9)
    rows = {f: [i for i, x in enumerate(features) if f in x] for f in range(90)}
    marker = {f for f, held in rows.items() if len(held) >= 5 and sum(toxic[i] for i in held) >= 0.9 * len(held)}
    n = [sum(int(f) in marker for f in x) for x in features]
    cuts = np.quantile([n[i] for i in range(120) if toxic[i]], [1 / 3, 2 / 3])
    assert got.tolist() == [0 if not toxic[i] else 1 + sum(n[i] > c for c in cuts) for i in range(120)]
    assert set(got.tolist()) == {0, 1, 2, 3}


def test_planted_passages_are_broken_up(spark):
    """Passages of over 50 words in two documents each: of the later copies most words go, and of all other texts nothing."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rnd.randrange(55, 90))) for _ in range(120)]
    rows, own = [], {}
    for i in range(240):
        before, after = (" ".join(word() for _ in range(rnd.randrange(5, 120))) for _ in range(2))
        glue = rnd.choice([" ", "\n"])
        rows.append((i, glue.join([before, passages[i % 120], after])))
        own[i] = before, after
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == rows[i][1] for i in range(120))
    broken = 0
    for i in range(120, 240):
        before, after = own[i]
        assert got[i].startswith(before[: len(before) // 2]) and got[i].endswith(after[len(after) // 2 :])
        gone = len(rows[i][1]) - len(got[i])
        assert gone <= len(passages[i - 120]) + 2
        broken += passages[i - 120] not in got[i]
    assert broken >= 0.9 * 120


def test_known_licences_need_an_anchor(spark):
    docs = spark.createDataFrame([(1, "You are permitted to do as you like.")], "doc_id long, text string")
    assert [r["licence"] for r in licences.scan(docs, known=[("own", "You are permitted to do as you like")]).collect()] == ["own"]
    with pytest.raises(ValueError, match="own"):
        licences.scan(docs, known=[("own", "Do as you like.")])

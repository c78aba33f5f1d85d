"""The operators against brute-force versions on small tables, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ethospark.llm import byte_bpe, decontaminate, licences, line_dedup, minhash, simhash, style_tree, toxicity, unigram, wavelet
from ethospark.llm.common import table, tokenizer_path, written

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "  a   b\n\n c\t \x1cq\x1f \x85z᠎ ​　⁠﻿  "),
    (None, "x y"),
    (5, "don't ''s 'S I'll\r\n  '"),
    (6, "🙂🙂 héllo ²½٣ Ⅷ ʰ ́x \x00a"),
    (7, "ab" * 400 + " " * 50 + "." * 90),
    (8, " lead trail "),
    (9, "same words twice"),
    (10, "same words twice"),
    (11, "x <|endoftext|> y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


# 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>if (a<b) "</p>"</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<div class="with-sidebar"><aside>Side</aside><article class="post"><header><h1>Big &amp; bold</h1><p>By X</p></header><p>One <b>two</b>three<br>four <p>Five&nbsp;six<!-- c --><div class="ad-box">Buy</div>
<ul><li>seven<li>eight</ul><form><input name=q>Find</form><section id="comments"><article class="comment"><p>Nice!</p></article></section></article></div><footer>&copy; Me</footer>"""


def test_page_to_text(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.b/d", "<p>no article <a href='/x'>here</a></p><div class=footer>f</div><"), (None, "http://a.b/e", "plain")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in style_tree.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert got[1]["text"] == "Big & bold One twothree four Five six seven eight"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[None]["text"]) == ("", "", "no article here <", "plain")


def test_repeated_branch_is_noise(spark):
    rnd = random.Random(1)
    body = "<div class='x'><p>Read our great paper every day</p></div><div class='y'><p>{}</p></div>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", body.format(" ".join(str(rnd.random()) for _ in range(9)))) for i in range(40)], "page_id long, url string, html string")
    got = style_tree.extract(pages).collect()
    assert len(got) == 40 and not any("paper" in r["text"] or not r["text"] for r in got)
    low = {r["path"] for r in style_tree.importance(pages).where(F.col("measure") < style_tree.LOW).collect()}
    assert any(".x" in p for p in low) and not any(".y" in p for p in low)


def test_tree_decides_on_unnamed_branches(spark):
    """Without the tree the repeated branch stays; a host of two pages keeps it, and equal pages count once."""
    rnd = random.Random(5)
    body = "<div class='q1'><p>Read our great paper every day</p></div><article><p>{}</p><div class='q2'>All text is free</div></article>"
    page = lambda: body.format(" ".join(str(rnd.random()) for _ in range(9)))
    rows = [(i, f"http://many/{i}", page()) for i in range(12)] + [(100 + i, f"http://few/{i}", page()) for i in range(2)] + [(200 + i, "http://copies/x", body.format("same")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    assert not any("free" in got[i] for i in range(12)) and all(got[i] for i in range(12))
    assert all("free" in got[i] for i in range(100, 102)) and all(got[i] == "same All text is free" for i in range(200, 230))
    without = {r["page_id"]: r["text"] for r in style_tree.extract(pages, low=1e-9).collect()}
    assert all("free" in without[i] for i in range(12))


def test_importance_equals_entropies(spark):
    """The measures of a leaf and of the branch above it against the formulas written out."""
    import math

    texts_ = ["a", "a", "b", "c", "a", "d"]
    pages = spark.createDataFrame([(i, "http://h/", f"<div><p>{t}</p><i>{i}</i></div>") for i, t in enumerate(texts_)], "page_id long, url string, html string")
    got = {r["path"]: r for r in style_tree.importance(pages).collect()}
    m, sure = 6, 5 / (5 + style_tree.PRIOR)
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(m)
    look = 1 - sure  # the sequence of children is the same on all pages
    content = 1 - sure + sure * (1 - sum(entropy([c]) if c == 1 else entropy([1] * c) for c in (3, 1, 1, 1)) / 4)
    weight = 1 - style_tree.GAMMA
    leaf = (weight * look + content) / (weight + 1)
    found = next(r for path, r in got.items() if path.endswith("/div/p"))
    assert found["pages"] == m and abs(found["measure"] - leaf) < 1e-9


def test_names_are_evidence_and_no_verdict():
    def text(body):
        found = [x for x in style_tree.blocks(body)[0] if not x[1]]
        return " ".join(x[3] for x in found if x[2] or not any(y[2] for y in found))

    prose = "word " * 50
    for kept in ('<p class="notice-period">{}</p>', '<div class="search-engine-history">{}</div>', '<section id="legal-history">{}</section>', '<table class="menu"><tr><td>{}</table>', "<header><h1>T</h1><p>{}</p></header>"):
        assert "The period of notice is four weeks for all." in text(f"<article><p>a</p>{kept.format('The period of notice is four weeks for all.')}</article>"), kept
    for gone in ('<ol class="commentlist"><li>{}</ol>', '<div class="discussion">{}</div>', '<div id="comments-12">{}</div>', '<div class="ad-box">{}</div>', '<p class="ad">{}</p>', '<div class="share-buttons">{}</div>', '<header><p>{}</p></header>', '<div class="cookie-notice">{}</div>', "<aside>{}</aside>", '<div class="related-posts">{}</div>'):
        assert text(f"<article><p>a</p>{gone.format('By X')}<p>b</p></article>") == "a b", gone
    # Much prose survives a name of several meanings, links and adverts don't.
    assert prose.strip() in text(f'<article>x<div class="notice">{prose}</div></article>')
    assert "word" not in text(f'<article>x<div class="notice"><a href="/">{prose}</a></div></article>') and "word" not in text(f'<article>x<div class="ads">{prose}</div></article>')
    assert "word" not in text(f'<article>x</article><div class="notice">{prose}</div>')
    # A teaser of another story goes, a second article of some length stays.
    assert text(f"<article>{prose}</article><article><h2>Other</h2><p>Read on</p></article>") == prose.strip()
    assert text(f"<main><h1>T</h1><article>{prose}</article><article>{prose}</article></main>").count("word") == 100
    assert text('<div class="post-commentary"><p>all of it</p></div>') == "all of it"


def test_branch_importance_equals_mean_and_maximum(spark):
    """A branch against means over its nodes, weighted by depth, and their maximum, written out."""
    import math

    rnd = random.Random(11)
    pages = [(i, "http://h/", f"<div><p>{rnd.choice('abc')}</p><ul><li>{rnd.choice('xy')}</li></ul>{'<i>1</i><h2>t</h2>' if i % 2 else ''}</div><div class='z'><p>same</p></div>") for i in range(9)]
    pages = list({p[2]: p for p in pages}.values())
    got = {r["path"]: r["measure"] for r in style_tree.importance(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    looks: dict = {}
    texts_: dict = {}
    for n, (_, _, page) in enumerate(pages):
        found, children = style_tree.blocks(page)
        for path, _, _, text in found:
            texts_.setdefault(path, {}).setdefault(text, []).append(n)
        for path in {p[:i] for p, *_ in found for i, c in enumerate(p + "/") if c == "/" and i}:
            looks.setdefault(path, []).append(tuple(children.get(path, ())))
    own = {}
    for path, seen in looks.items():
        m, styles = len(seen), set(seen)
        sure = (m - 1) / (m - 1 + style_tree.PRIOR)
        entropy = lambda counts, m=m: sum(-c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(m) if m > 1 else 0.0
        look = 1 - sure + sure * entropy([seen.count(s) for s in styles]) if m > 1 else 1.0
        weight = 1 - style_tree.GAMMA ** len(styles)
        parts = [(weight, look)]
        if path in texts_:
            parts.append((1.0, 1 - sure + sure * (1 - sum(entropy([w.count(p) for p in set(w)]) for w in texts_[path].values()) / len(texts_[path])) if m > 1 else 1.0))
        own[path] = m, parts
    depth = lambda p: p.count("/")
    under = lambda p: [q for q in own if q == p or q.startswith(p + "/")]
    mean = {}
    for p in own:
        cells = [(own[q][0] * w * style_tree.GAMMA ** (depth(q) - depth(p)), v) for q in under(p) for w, v in own[q][1]]
        mean[p] = sum(w * v for w, v in cells) / sum(w for w, _ in cells)
    assert len(got) > 4 and got.keys() == own.keys()
    for p in own:
        assert abs(got[p] - max(mean[q] for q in under(p))) < 1e-9, p


def test_pages_without_rows_and_long_names(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert style_tree.extract(none).count() == 0
    long = "<div class='{0}-one'><p>x</p></div><div class='{0}-two'><p>y</p></div>".format("n" * 60)
    paths = {r["path"] for r in style_tree.importance(spark.createDataFrame([(1, "http://h/", long)], "page_id long, url string, html string")).collect()}
    assert sum(p.endswith("/p") for p in paths) == 2


def test_pages_of_the_table(spark, sf):
    for r in table(spark, sf, "pages").join(style_tree.extract(table(spark, sf, "pages")).select("page_id", "text"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        import html

        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article[1]))).split()) if article else ""
        assert r["text"] == want


# 2


def test_shards_give_back_all_ids(spark, odd, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs, size in ((odd, 7), (documents.limit(120), 3000)):
        got = {r["doc_id"]: r for r in wavelet.read_documents(wavelet.with_starts(written(wavelet.shards(docs, path, 2, shard_tokens=size), "t"))).collect()}
        at = 0
        for key, text in sorted(texts(docs).items(), key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
            assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)


@pytest.mark.parametrize("top", [1, 2, 300, 70000])
def test_wavelet_matrix(top):
    a = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    s = wavelet.Shard(wavelet.build(a, [1], [3000]))
    assert (s.tokens() == a).all()
    for i in range(0, 3000, 97):
        x = int(a[i])
        assert s.access(i) == x and s.rank(x, i) == (a[:i] == x).sum() and s.select(x, s.rank(x, i)) == i
    assert s.select(top + 5, 0) == -1 and s.rank(1 << 20, 3000) == 0


def test_shards_answer_from_the_payload(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = odd.union(odd.where("doc_id in (7, 9)")).withColumn("part", F.lit("clash"))
    table_ = wavelet.with_starts(written(wavelet.shards(docs, path, 2, shard_tokens=40), "t"))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()), key=lambda r: r[:2])
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for _, _, t in rows]
    flat = [x for d in ids for x in d]
    for token in (2, flat[5], 220, 49999):
        n = flat.count(token)
        assert [r["n"] for r in wavelet.counts(table_, [token]).collect()] == ([n] if n else [])
        assert wavelet.locate(table_, token).count() == n
    found = sorted((r["doc_id"] or 0, r["position"]) for r in wavelet.locate(table_, 2).collect())
    assert found == sorted((i, len(d) - 1) for (_, i, _), d in zip(rows, ids, strict=True))
    places = [0, 3, len(flat) - 1, len(flat) + 9]
    assert {r["place"]: r["token"] for r in wavelet.tokens_at(table_, places).collect()} == {p: flat[p] for p in places[:3]}
    text = wavelet.read_documents(wavelet.with_starts(written(wavelet.shards(docs, path, 2, special_as_text=True), "t"))).where("doc_id = 11").first()
    tokenizer.encode_special_tokens = True
    assert text["n_tokens"] == len(tokenizer.encode("x <|endoftext|> y", add_special_tokens=False).ids) + 1


def test_empty_shards(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.read_documents(wavelet.with_starts(written(wavelet.shards(none, tokenizer_path("byte_bpe_50k.json"), 2), "t"))).count() == 0


# 3


def test_toxicity_on_held_out_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rnd = random.Random(3)
    bad = ["zork", "blarg", "fnord"]
    made = [(10**6 + i, " ".join([rnd.choice("red green blue cat dog tree house".split()) for _ in range(30)] + ([rnd.choice(bad)] * rnd.randint(1, 4) if i % 2 else [])), i % 2) for i in range(400)]
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(d.where("doc_id % 4 < 2"), d.where("doc_id % 4 < 2").select("doc_id", "toxic"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = toxicity.score(d.where("doc_id % 4 >= 2"), model)
    assert held.where("rejected <> (toxic = 1)").count() == 0
    assert held.agg(F.corr("severity", F.size(F.split("text", "zork|blarg|fnord")))).first()[0] > 0.5
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    assert scored.where("toxic = 0 and rejected").count() == 0 and scored.where("toxic = 1 and not rejected").count() <= 2


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd.withColumn("severity", F.lit("clash")), toxicity.train(odd, none))
    assert got.count() == len(ODD) and got.where("rejected or severity <> 0").count() == 0


# 4


def test_bpe_equals_tiktoken(spark, odd, documents):
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = odd.union(documents.where("doc_id >= 12").limit(60))
    for words, size in ((50, 10**7), (50, 500), (10**6, 300)):  # the table of words starts anew, within a batch too, or never
        got = byte_bpe.digests(byte_bpe.encode(docs.coalesce(2), path, public_tokenizers.PATTERN, decoded=True, max_words=words, chunk_bytes=size)).collect()
        known = texts(docs)
        assert len(got) == docs.count()
        for r in got:
            ids, text = codec.encode_ordinary(known[r["doc_id"]]), known[r["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_long_and_whole_words(spark):
    import tiktoken

    path, rnd = tokenizer_path("byte_bpe_multi_50k.tiktoken"), random.Random(1)
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = [(1, "".join(rnd.choice("abcdefghij") for _ in range(100_000))), (2, "ab" * 300), (3, "a" * 5000 + " " + "é" * 400), (4, "x" * 256), (5, "x" * 257), (6, "the the of"), (6, "the")]
    got = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3), path, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got) == sorted((i, codec.encode_ordinary(t), t.encode()) for i, t in rows)


# 5


def test_licences(spark):
    mit = licences.WHOLE["MIT"][0]
    data = [(1, "Copyright (c) 2020 Me\n\n" + mit.upper()), (2, "text\nReleased under the MIT licence.\nmore"), (3, "Licensed under CC BY-NC 4.0."), (4, "Released under the MIT License and more."), (5, None), (6, ""), (7, "intro\n\n" + mit.replace("\n\n", "\n") + "\n\nend"), (None, "SPDX-License-Identifier: ISC")]
    got = sorted((r["doc_id"] or 0, r["unit"], r["position"], r["licence"]) for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(0, "text", 0, "ISC"), (1, "blocks", 1, "MIT"), (1, "text", 0, "MIT"), (2, "line", 1, "MIT"), (3, "text", 0, "CC-BY-NC-4.0"), (7, "block", 1, "MIT")]
    assert licences.canonical("The Licence, v2.0 — © me") == "the license 2 0 me"
    assert all(re.search(licences.ANCHORS, licences.canonical(t)) for _, t in licences.known_texts())
    inside = [(1, f"intro\n\n{mit}\n\nend"), (2, "a\n \n" + licences.WHOLE["BSD-3-Clause"][0].upper()), (3, "x\n\n" + licences.APACHE_NOTICE + "\n\ny"), (4, licences.GNU_NOTICE.format("", "version 3 of the").replace("version version", "version"))]
    own = [("LicenseRef-own", "You are permitted to smile")]
    got = sorted((r["doc_id"], r["unit"], r["position"], r["licence"]) for r in licences.scan(spark.createDataFrame([*inside, (5, "You are PERMITTED to smile!")], "doc_id long, text string"), known=own).collect())
    assert got == [(1, "blocks", 1, "MIT"), (2, "blocks", 1, "BSD-3-Clause"), (3, "blocks", 1, "Apache-2.0"), (5, "text", 0, "LicenseRef-own")]


def test_licences_equal_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(f"SELECT doc_id, unit, position, licence, digest FROM ({licences.oracle()})").fetchall()))
    assert sorted(map(tuple, licences.scan(table(spark, sf, "documents")).collect())) == want and want


# 6


def test_unigram_equals_viterbi(spark, odd, documents):
    path = tokenizer_path("piece_bpe_32k.model")
    pieces = unigram.read_pieces(path)
    unknown = min(pieces.values()) - unigram.UNKNOWN

    def best(word):
        s = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            s.append(max([(s[e - 1][0] + size * unknown, s[e - 1][1] - size)] + [(s[b][0] + pieces[word[b:e]], s[b][1] - 1) for b in range(max(0, e - 32), e) if word[b:e] in pieces]))
        return -s[-1][1]

    docs = odd.union(documents.where("doc_id >= 12").limit(40))
    known = texts(docs)
    for limit in (20, 10**6):
        got = unigram.token_counts(docs, path, max_words=limit).collect()
        assert len(got) == docs.count()
        for r in got:
            words = known[r["doc_id"]].split()
            assert (r["n_words"], r["n_tokens"]) == (len(words), sum(best(unigram.MARK + w) for w in words))
    trie = unigram.Trie(pieces)
    ends = [trie.add(w) for w in ("▁abcdef", "▁abcdeg", "▁abc", "▁abcdef")]
    assert trie.nodes == 8 and ends[0] == ends[3]  # shared prefixes are scored once


# 7


def words_run(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_repeated_passages_go(spark):
    passage = words_run(0, 70)
    rows = [(i, f"{words_run(i + 1, 60)} {passage} {words_run(i + 100, 60)}") for i in range(12)]
    rows += [(20, words_run(300, 200)), (21, "short line\n" * 30), (22, None), (23, ""), (24, " \n "), (25, words_run(5, 20) + " same tail"), (26, words_run(6, 20) + " same tail"), (30, words_run(400, 80)), (31, words_run(400, 80)), (31, words_run(400, 80)), (None, words_run(401, 80)), (40, words_run(401, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_chars", F.lit("clash")).withColumn("n_chars", F.length("text").cast("long"))
    got = line_dedup.dedup(docs)
    out: dict = {}
    for r in got.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert got.count() == len(rows) and out[0][0]["text"] == rows[0][1]
    for i in range(1, 12):
        text = out[i][0]["text"]
        assert passage not in text and out[i][0]["n_chars"] == len(text) and out[i][0]["removed_chars"] == len(rows[i][1]) - len(text)
        assert len(set(text.split()) & set(passage.split())) < 40
        assert text.startswith(words_run(i + 1, 60)[:200]) and text.endswith(words_run(i + 100, 60)[-200:])
    for i in (20, 21, 22, 23, 24, 25, 26, 30, None):
        assert out[i][0]["text"] == dict(rows)[i]
    assert [r["text"].strip() for r in (*out[31], *out[40])] == [""] * 3


def test_chunks_do_not_depend_on_neighbours():
    powers = line_dedup._Powers()
    texts_ = [words_run(i, 5 + 17 * i).encode() for i in range(12)] + [b"", b" ", b"\n\n", b"one"]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts_[:-1]]])
    a, b, words, hashed = line_dedup.chunks(b"\n".join(texts_) + b"\n", begins, powers)
    doc = np.searchsorted(begins, a, side="right") - 1
    for i, t in enumerate(texts_):
        alone = line_dedup.chunks(t + b"\n", np.zeros(1, np.int64), powers)
        assert (alone[3] == hashed[doc == i]).all() and (alone[0] == a[doc == i] - begins[i]).all() and alone[2].sum() == len(t.split())


# 8


def shingles(text: str, n: int = 5) -> set:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").limit(60).collect()] + [(1000, None), (1001, ""), (1002, " "), (1003, "two words"), (1004, "two words"), (1005, "🙂é" * 9)]
    got = {r["doc_id"]: r for r in minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    errors = []
    for n, (key, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edit = text[: len(text) - q] + after[:q]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        for found, other in ((r["near_edited"], edit), (r["near_next"], after)):
            a, b = shingles(text), shingles(other)
            errors.append(abs(found - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.02
    assert got[1003]["fingerprint"] == got[1004]["fingerprint"] and got[1000]["fingerprint"] == "" and len(got[1003]["fingerprint"]) == minhash.BINS * minhash.BITS // 4


def test_fingerprints_of_nulls_and_nothing(spark):
    assert minhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = minhash.fingerprints(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["doc_id"] is None


# 9


def simple_fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def all_pairs(fps: dict, radius: int) -> dict:
    root = {k: k for k in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_simhash_components(spark, odd, documents):
    docs = odd.union(documents.where("doc_id >= 12"))
    fps = {k: simple_fingerprint(t) for k, t in texts(docs).items()}
    want = all_pairs({k: v for k, v in fps.items() if k is not None}, 3)
    for r in simhash.near_duplicates(docs).collect():
        assert int(r["fp"].hex(), 16) == fps[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]


def test_rows_without_an_id_link_and_bridge(spark, monkeypatch):
    """Fingerprints that only rows without an id have are nodes like any other."""
    chain = [0, 0b11, 0b1111, 0b111111, 2**40 - 1, (2**40 - 1) ^ (7 << 41), 2**63]
    ids = [5, None, None, 9, None, None, 7]
    rows = [(i, bytearray(f.to_bytes(8))) for i, f in zip(ids, chain, strict=True)] + [(5, bytearray((2**63).to_bytes(8)))]
    fps = spark.createDataFrame(rows, "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: fps)
    got = sorted(((r["doc_id"] or 0), int(r["fp"].hex(), 16), r["component_id"]) for r in simhash.near_duplicates(fps).collect())
    want = [(5, 0, 5), (0, 3, 5), (0, 15, 5), (9, 63, 5), (0, chain[4], None), (0, chain[5], None), (7, 2**63, 5), (5, 2**63, 5)]
    assert got == sorted(want)


def test_components_name_their_own_centre(spark, monkeypatch):
    """The node that all others of a component hang on has a row too, and its least id counts like theirs."""
    found = simhash.components(spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)]
    rnd = random.Random(11)
    rows = [(rnd.getrandbits(40), c ^ (1 << rnd.randrange(64))) for c in [rnd.getrandbits(64) for _ in range(30)] for _ in range(8)]
    fps = spark.createDataFrame([(i, bytearray(f.to_bytes(8))) for i, f in rows], "doc_id long, fp binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: fps)
    want = all_pairs(dict(rows), 3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(fps).collect()} == want


def test_simhash_links_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rnd = random.Random(9)
    centre = [rnd.getrandbits(64) for _ in range(3)]
    fps = {i: centre[i % 3] ^ sum(1 << b for b in rnd.sample(range(60), rnd.randint(0, 4))) for i in range(300)}
    least: dict = {}
    for k, v in fps.items():
        least.setdefault(v, k)
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8))) for v, k in least.items()], "id long, fp binary")
    got = {r["id"]: r["root"] for r in simhash.components(simhash.links(df, 3)).collect()}
    want = all_pairs({k: v for v, k in least.items()}, 3)
    assert {k: got.get(k, k) for k in want} == want


# 10


def test_myers_equals_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(lo, 15))) for lo in (1, 0))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.myers(a, decontaminate._masks(a), b, 99)[0] == min(row)


def test_edited_items_are_found(spark):
    rnd = random.Random(4)
    items = [(i, words_run(1000 + i, 25)) for i in range(30)] + [(90, "tiny"), (91, None), (92, "")]
    docs, edits = [], {}
    for i, text in items[:30]:
        budget = int(decontaminate.RATE * len(decontaminate.normalize(text)))
        cut = list(text)
        edits[i] = budget if i % 3 else 3 * budget
        for p in rnd.sample([p for p, c in enumerate(cut) if c != " "], edits[i]):
            cut[p] = "z"
        docs.append((i, f"{words_run(i, 40)}\n {''.join(cut).upper()}   {words_run(i + 50, 40)}"))
    docs += [(50, "Tiny "), (51, "(TINY) but more"), (55, "tinyish"), (52, None), (53, ""), (54, words_run(77, 300))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(d, b).collect()}
    assert set(got) == {(i, i) for i in range(30) if i % 3} | {(50, 90), (51, 90)}
    assert all(got[i, i] <= edits[i] for i in range(30) if i % 3)
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, b).collect()) == sorted(k for k, _ in docs if k not in {x for x, _ in got})
    assert decontaminate.find(d, b.limit(0)).count() == 0


def test_items_without_an_id_are_found(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"so {text} it was"), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (3, text), (None, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).orderBy(F.col("item_id").asc_nulls_last()).collect()] == [(1, 3), (1, None)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items.where("item_id is null")).collect()] == [2]


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (200,))
    items = [(i, words_run(3000 + i, 20)) for i in range(12)] + [(3, words_run(3000, 20))]
    docs = spark.createDataFrame([(i, f"{words_run(i, 9)} {t}") for i, t in items[:6]] + [(50, "none")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in decontaminate.blocks(b)) > 1
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, b).collect()}
    assert got == {(i, i) for i in range(6)} | {(0, 3)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, b).collect()] == [50]


# All operators: tables without rows and columns of clashing names


def test_empty_tables_and_clashing_columns(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    made = [
        lambda d: toxicity.score(d, toxicity.train(d, labels)),
        lambda d: toxicity.clean(d, toxicity.train(d, labels)),
        lambda d: byte_bpe.digests(byte_bpe.encode(d, path, public_tokenizers.PATTERN, decoded=True)),
        licences.scan,
        lambda d: unigram.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
        line_dedup.dedup,
        minhash.fingerprints,
        simhash.near_duplicates,
        lambda d: decontaminate.find(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    ]
    for f in made:
        assert f(none).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (3, "")], "doc_id long, text string")
    names = "starts ends _id _key _at id key hash fp rows salt component_id p_toxic severity grade rejected removed_chars toxic features words refs ids decoded chars unit position licence digest n_words n_tokens log_prob range lanes next edit item_id distance end a b bucket".split()
    clash = docs.select("*", *[F.lit("clash").alias(n) for n in names])
    for f in made:
        assert f(clash).count() == f(docs).count()
    kept = line_dedup.dedup(clash)
    assert set(kept.columns) == set(clash.columns) and kept.where("starts <> 'clash' or _key <> 'clash'").count() == 0
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash.withColumn("n_chars", F.length("text").cast("long")), sf)
        assert got.where("severity <> 'clash' or removed_chars <> 'clash' or rejected <> 'clash'").count() == 0, name


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    from ethospark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).union(spark.range(300).select(F.lit(3).cast("long"), F.col("id") + 1000))
    groups = written(rows.groupBy("k").agg(F.count("*").alias("rows"), F.min("v").alias("least")).where("k <> 5"), "t")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.join_split(rows, groups, "k", "rows", how).select("k", "v", "least").collect()), key=str)
        assert got == sorted(map(tuple, rows.join(groups.drop("rows"), "k", how).select("k", "v", "least").collect()), key=str)


# Near duplicates of the pipeline


def test_pipeline_near_duplicates_equal_all_pairs(spark, monkeypatch):
    import corpus_pipeline
    from ethospark.llm import shingles as exact

    monkeypatch.setattr(exact, "TILE", 16)
    rnd = random.Random(12)
    tail = words_run(5, 6)
    made = []
    for i in range(60):  # single changed words, so that similarities are from 0.4 to 1; a common line in all
        base = words_run(i + 500, rnd.choice((40, 60, 120))).split()
        for _ in range(3):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), rnd.randint(0, 5)):
                copy[at] = "z"
            made.append(" ".join(copy) + " \n" + tail)
    centre = words_run(900, 150).split()
    for i in range(90):  # a large group of near copies
        made.append(" ".join([*centre[: i % 7], f"w{i}", *centre[i % 7 + 1 :], *([f"e{i}"] * (i % 3))]))
    made += [words_run(2000 + i, 6) for i in range(300)] + ["", " ", "\n"] + ["a b", "A  b", "a b c"]
    rnd.shuffle(made)
    rows = [*enumerate(made, 1), (None, made[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: shingles(t.lower()) for i, t in enumerate(made, 1)}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a + 1, len(made) + 1):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and (10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert 100 < sum(k != v for k, v in root.items()) < 300
    left = sorted(r["doc_id"] or 0 for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left == [0, 0, *sorted(k for k, v in root.items() if k == v)]


# Pipeline


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, sf), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        if name == "toxicity":
            assert len(after & toxic) <= 2 and before.keys() - after <= toxic | {k for k in before if k not in {r["doc_id"] for r in table(spark, sf, "labels").collect()}}
        if name == "line_dedup":
            assert after == set(before)
        if name == "decontamination":
            items = [decontaminate.normalize(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            assert before.keys() - after >= {k for k, r in before.items() if any(x in decontaminate.normalize(r["text"]) for x in items)}
        if name != "byte_bpe":
            assert docs.columns == table(spark, sf, "documents").columns
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_components_of_a_long_shuffled_chain(spark):
    names = random.Random(7).sample(range(10_000), 1000)
    df = spark.createDataFrame([*zip(names, names[1:], strict=False), (20_000, 20_001)], "a long, b long")
    found = {r[0]: r[1] for r in simhash.components(df).collect()}
    assert {found.get(x, x) for x in names} == {min(names)} and found[20_001] == 20_000


def test_rows_of_one_id_are_told_apart(spark):
    import corpus_pipeline

    text = words_run(1, 60)
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (2, words_run(2, 60)), (3, words_run(3, 60))], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())) == [(1, text), (2, words_run(2, 60)), (3, words_run(3, 60))]


def test_fold_of_merges_is_short_and_equals_the_heap(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe._known(path) is byte_bpe._known(path)  # once a Python worker, not once a task
    words = byte_bpe._Words(public_tokenizers.PATTERN, path, 100)
    made = [b"a", b"aa", b"aaaaaaaaa", b" onononon", b"\x00\xff\x00\xff", " héhéhé".encode(), b" thatndouthatndou", b"\xe2\x82\xac" * 9]
    rows = spark.createDataFrame([(k, words.start(w)) for k, w in enumerate(made)], "k int, s struct<w:string,r:string>")
    fold = byte_bpe.let(byte_bpe.rank_table(words.ranks), lambda t: byte_bpe.fold_merges(F.col("s"), t))
    got = [r["c"] for r in rows.select("k", fold.alias("c")).orderBy("k").collect()]
    assert got == [f"{byte_bpe.EDGE}{byte_bpe.merge_long(w.decode('latin-1'), words.pairs)}{byte_bpe.EDGE}" for w in made]
    step = str(byte_bpe.fold_merges(F.col("s"), F.col("t")))
    assert "concat(" not in step and step.count("transform(") <= 4


def test_fit_of_toxicity_holds_no_wide_copies_of_all_features():
    import tracemalloc

    rng = np.random.default_rng(3)
    features = [np.sort(rng.choice(40_000, 5000, replace=False)).astype(np.int32) for _ in range(400)]
    y = (np.arange(400) % 3).astype(np.int64)
    tracemalloc.start()
    toxicity.fit(features, y, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(x.nbytes for x in features)  # was 10 times


def test_near_duplicates_shuffle_the_hashes_of_prefixes_once(spark, monkeypatch):
    from ethospark.llm import shingles as exact

    seen = {}
    monkeypatch.setattr(exact, "written", lambda df, name: seen.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    text = " ".join(f"w{k}" for k in range(60))
    # One id has a text twice and another one too; a row without an id has it as well.
    docs = spark.createDataFrame([(1, text), (1, text), (1, "quite another text of a few words"), (2, text + " end"), (None, text), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in exact.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3)}
    assert "first(hashes" not in seen["candidates"][0]


def test_near_duplicates_keep_one_row_of_each_group(spark):
    import corpus_pipeline
    from ethospark.llm import shingles as exact

    words = words_run(3, 100).split()
    near = [" ".join([*words[:k], *["z"] * (100 - k)]) for k in (100, 98, 96, 94, 92, 90, 88, 86, 84)]  # neighbours link, and the ends by them only
    other = words_run(4, 60)
    # One id has two texts of a group and one of them twice; a chain of rows without an id joins 1 and 9; a group has no id at all.
    rows = [(1, near[0]), (1, near[0]), (1, near[1]), *[(None, t) for t in near[2:8]], (None, near[4]), (9, near[8]), (None, other), (None, other), (None, other + " end"), (5, "a b c d e f"), (5, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact.near_duplicates(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.where("doc_id is not null").collect()} == {1: 1, 9: 1, 5: 5}
    assert sorted(r["component_id"] or 0 for r in found.where("doc_id is null").collect()) == [0, 0, 0, *[1] * 7]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert [i for i, _ in left] == [0, 0, 1, 5]
    assert left[2][1] in near[:2] and {t in (other, other + " end") for i, t in left if not i} == {True, False}

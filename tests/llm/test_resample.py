"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from ethospark.llm import resample
from ethospark.llm.common import table
from ethospark.llm.queries import QUERIES


def features(text, longest: int = 1) -> tuple[int, list[str]]:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    every, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * every / ((s[b] + 1.0) * wanted)))
    out = []
    for i, text in docs:
        n, f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    ranks: dict = {}
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(x, []).append(rank)
    return sorted((x[0] if x[0] is not None else -1, *x[2:], (ranks.get(x) or [0]).pop(0) if ranks.get(x) else 0) for x in out)


def rows_of(df) -> list[tuple]:
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in df.collect())


def test_resample_equals_the_plain_version(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "éa", "UP", "up", "🙂"]
    text = lambda lo, hi: " ".join(rnd.choices(vocabulary, k=rnd.randrange(lo, hi)))
    docs = [(i, text(0, 60)) for i in range(700)] + [(1000, None), (1001, ""), (None, text(30, 40)), (1002, "up " * 50_000), (1003, "-- !!")] + [(7, "same words " * 15)] * 6
    target = [" ".join(rnd.choices(vocabulary[:40], k=20)) for _ in range(40)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_words", "3 AS buckets", "4 AS rank")
    wanted = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "5 AS doc_id")
    assert rows_of(resample.resample(frame, wanted)) == brute(docs, target)
    assert rows_of(resample.resample(frame, wanted, longest=3, buckets=64, percent=45, least_words=5)) == brute(docs, target, 3, 64, 45, 5)
    # Ties: with one bucket all weights are alike and only the noise decides; rows of one id have the same score.
    assert rows_of(resample.resample(frame, wanted, buckets=1, percent=100, least_words=0)) == brute(docs, target, 1, 1, 100, 0)


def test_nothing_to_draw(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert rows_of(resample.resample(frame, none)) == brute([(1, "a b"), (2, None)], [])
    assert resample.resample(frame.limit(0), none).count() == 0


def test_query_of_the_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    target = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    got = QUERIES["op13_resample"](spark, sf)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert rows_of(got) == brute(docs, target)

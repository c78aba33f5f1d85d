"""The divergence audit against sums over all terms, written out plainly in Python integers, and against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb

from ethospark.llm import divergence
from ethospark.llm.queries import ORACLES, QUERIES


def brute(rows, least: int, top: int) -> list[tuple]:
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", words(text)
        groups.add((lang, source))
        held[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    p = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for lang, source in groups:
        kept = [t for t, d in held[lang].items() if d >= least]
        sources = [s for x, s in groups if x == lang]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        own = {s: {t: p(n[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        every = {t: p(sum(n[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        pairs = [(s, sum(f(own[source][t], own[s][t]) for t in kept)) for s in sources if s != source]
        terms = [(t, f(own[source][t], every[t])) for t in kept if n[lang, source][t] > 0 and own[source][t] > every[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def rows_of(df) -> list[tuple]:
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_equals_sums_over_terms(spark, monkeypatch):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "Ünd", "UND", "🙂", "ｚ"]
    rows = []
    for _ in range(400):
        lang, source = rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "a", "a", "b", "c", None, "é", "Z"])
        rows.append((lang, source, " ".join(rnd.choices(vocabulary, k=rnd.randrange(30), weights=[1 / (i + 1) for i in range(len(vocabulary))]))))
    rows += [("en", "none", None), ("en", "none", "1 2 3"), ("xx", "a", "lonely"), ("xx", "b", ""), ("en", "long", "rare " * 30_000), ("zz", "one", "x")] + [("en", "a", "same text")] * 12
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS a", "4 AS total")
    for least, top in ((10, 10), (1, 3), (40, 1)):
        assert rows_of(divergence.audit(docs, least, top)) == brute(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0
    # Counts given out in small parts, and texts cut into small pieces, are the same counts.
    for name, value in (("HELD", 7), ("OUT", 3), ("PIECE", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(docs)) == brute(rows, 10, 10)


def test_large_counts_stay_exact():
    for count, n, v in ((10**11, 10**13, 10**6), (7, 3 * 10**12, 5), (0, 0, 1)):
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        lit = lambda x: F.lit(x).cast("long")
        got = SparkSession.active().range(1).select(divergence.scaled(lit(count), lit(n), lit(v)).alias("p")).first()["p"]
        assert got == 1 + 10**9 * (count + 2) // (n + 2 * v)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.sql(ORACLES["op12_divergence"])
    at = [res.columns.index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    want = sorted(tuple(r[i] for i in at) for r in res.fetchall())
    assert want and rows_of(QUERIES["op12_divergence"](spark, sf)) == want

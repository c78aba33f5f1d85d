"""Source divergence audit: how far the word use of a language's sources lies apart, in exact integers.

Every source of a language is a smoothed distribution over the language's kept terms, p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and
two of them differ by the sum of f(p, q) = floor((p - q)² / (p + q)) over all kept terms. p depends on the term's count
only, so a pair of sources needs no list of terms: it needs its **joint count histogram**, the number of terms for each combination
(count here, count there). f is evaluated once a combination and multiplied.

* Terms are counted by (language, source, term) within tasks and again before the shuffle, so a hot source costs no more than its vocabulary.
* Terms whose counts are the same in all sources are merged to one vector with a multiplicity before any pair is made; most terms
  of a Zipfian vocabulary are rare and fall together. Pairs are those of the sources of a vector, and the result has a row a pair anyway.
* Only combinations with both counts above zero are tallied. Combinations with a zero are implied: each source's own histogram of counts, less
  what the pair has in common, and V less everything for (0, 0).

Null text, language and source are ''. A source without any term is a group all the same, with zero counts. Rows are documents: repeated rows
count again. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import binary, map_batches, strings, written

#: Counts that a task holds, rows it gives out at once, and bytes of a text that it cuts at once.
HELD, OUT, PIECE = 500_000, 65_536, 1_000_000
SCALE = 1_000_000_000
SMOOTH = 2
LEAST_DOCUMENTS = 10
TOP = 10


def counted(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, d): occurrences of each term and documents that have it, added up over parts of a task.

    Terms are cut from the UTF-8 bytes, where everything in ASCII but letters becomes a space. A task gives out its counts and begins anew
    when it holds ``HELD`` of them, and a long text is taken in pieces, so neither grows with the input.
    """
    # A byte table: A-Z to lower case, other ASCII but a-z to a space, all else as it is.
    table = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def rows_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            words = list(n)
            for k in range(0, len(words), OUT):
                part = words[k : k + OUT]
                same = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[w] for w in part], pa.int64()), pa.array([d[w] for w in part], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(strings(batch, "lang"), strings(batch, "source"), binary(batch, "text"), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                text, own, at = text.translate(table), set(), 0
                while at < len(text):
                    end = text.find(b" ", at + PIECE)
                    words = text[at : end if end >= 0 else len(text)].split()
                    n.update(words)
                    own.update(words)
                    at = end if end >= 0 else len(text)
                d.update(own)
                size += len(n)
                if size > HELD:
                    yield from rows_of(held)
                    held, size = {}, 0
        yield from rows_of(held)

    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return map_batches(docs.select(none("lang"), none("source"), "text"), run, "lang string, source string, term string, n long, d long")


def counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (lang, term, v, total): each kept term's counts by source, an array of (source, n) in order of source.

    ``v`` is as long as the term has sources; that is bounded by the sources of a language, whose pairs the audit returns one by one.
    """
    # Tasks have added up already: rows are dealt first, so that they are added up once more and not twice.
    by_source = counted(docs).repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = by_source.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v"), F.sum("n").alias("total"), F.sum("d").alias("d"))
    return by_term.where(F.col("d") >= least).drop("d")


def scaled(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exactly; null without kept terms."""
    parts = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.nullif((n + SMOOTH * v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", parts, whole)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_histogram(kept: DataFrame) -> DataFrame:
    """Rows (lang, a, b, x, y, m): for sources a < b how many kept terms have x > 0 occurrences in a and y > 0 in b."""
    vectors = kept.groupBy("lang", "v").agg(F.count("*").alias("m"))
    # Two plain explodes: a source of a vector, then each later one.
    first = vectors.select("lang", "m", "v", F.posexplode("v").alias("i", "e")).where(F.col("i") + 1 < F.size("v"))
    pairs = first.select("lang", "m", "e", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("g"))
    pairs = pairs.select("lang", F.col("e.source").alias("a"), F.col("g.source").alias("b"), F.col("e.n").alias("x"), F.col("g.n").alias("y"), "m")
    return pairs.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    ``pair``: the distance to each other source of the language. ``term``: the ``top`` terms that are more frequent in the source
    than in its language, by the same f. Ranks start at 1 in each group and part, larger values first, then items in UTF-8 order.
    """
    kept = written(counts(docs, least), "counts")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    flat = kept.select("lang", "term", "total", F.explode("v").alias("e")).select("lang", "term", "total", "e.*")
    # A row for each language, and for each group, those without terms too.
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sums = flat.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_terms"))
    groups = docs.select(none("lang"), none("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("own_n", "own_terms", "terms", "lang_n")]), "groups")

    a = groups.select("lang", F.col("source").alias("a"), F.col("own_n").alias("a_n"), F.col("own_terms").alias("a_terms"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("own_n").alias("b_n"), F.col("own_terms").alias("b_terms"))
    pairs = a.join(b, "lang").where("a < b")

    both = written(joint_histogram(kept), "joint")
    own = flat.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cells = (
        both.select("lang", "a", "b", "x", "y", "m")
        # What a source's own histogram holds and the pair hasn't in common, meets a zero on the other side.
        .union(both.select("lang", "a", "b", "x", zero, -F.col("m")))
        .union(both.select("lang", "a", "b", zero, "y", -F.col("m")))
        .union(both.select("lang", "a", "b", zero, zero, F.col("m")))
        .union(pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", "n", zero, "m"))
        .union(pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero, "n", "m"))
        .union(pairs.select("lang", "a", "b", zero, zero, F.col("terms") - F.col("a_terms") - F.col("b_terms")))
    )
    cells = cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m <> 0").join(pairs, ["lang", "a", "b"])
    f = distance(scaled(F.col("x"), F.col("a_n"), F.col("terms")), scaled(F.col("y"), F.col("b_n"), F.col("terms")))
    values = cells.groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    values = pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = values.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))

    p, q = scaled(F.col("n"), F.col("own_n"), F.col("terms")), scaled(F.col("total"), F.col("lang_n"), F.col("terms"))
    told = flat.join(groups.drop("own_terms"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    by_term = told.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return by_pair.union(by_term)


def oracle() -> str:
    """The audit of ``documents`` in DuckDB, term by term."""
    return rf"""WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCUMENTS}),
    v AS (SELECT lang, count(*) AS terms, sum(total) AS n FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    own AS (SELECT g.lang, g.source, coalesce(sum(n.c), 0) AS n FROM groups g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
    p AS (SELECT o.lang, o.source, kept.term, coalesce(n.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(n.c, 0) + {SMOOTH})) // (o.n + {SMOOTH} * v.terms) AS p, 1 + ({SCALE}::HUGEINT * (kept.total + {SMOOTH})) // (v.n + {SMOOTH} * v.terms) AS q
        FROM own o JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = o.lang AND n.source = o.source AND n.term = kept.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM every)
    SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}"""

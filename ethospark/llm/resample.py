"""Importance resampling towards a target distribution, by hashed n-gram features.

A document's features are its runs of 1 to ``longest`` words, hashed to ``buckets`` buckets. A bucket's gain is the scaled logarithm of how much more
likely it is in the target than in the documents, smoothed by one; a document's weight is the mean gain of its features. Adding Gumbel noise
drawn from the id and taking the highest scores draws without replacement in proportion to the weights.

Scoring doesn't explode documents: higher-order functions make each document's array of buckets once (written, a small number a word), and a
fold adds up ``element_at`` of the literal array of all gains, which has an entry a bucket and no more. Only bucket totals, merged before
the shuffle, leave the tasks.

Ranks need no order of all documents either. Scores are whole numbers of a few tens of thousands of values, so the counts of scores give the rank at which each
score begins; a table of these that is as long as the gains and the noise are wide is broadcast. Only drawn documents are shuffled, by score, to
order those of one score by id.

A null or empty text has no features and weight 0. A null id draws its noise as an empty text and comes last among equal scores; rows of one id are documents of
their own with the same noise. Without documents of enough words none is drawn. Other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import let, written

#: Everything in ASCII but letters and digits parts words (upper case is lowered first).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
PERCENT = 10
#: Gains and noise are in thousandths.
UNIT = 1000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def features(tokens: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, repeats included."""
    # Words are taken one by one: a slice of an array copies the whole array first.
    run = lambda n: lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])
    starts = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    longer = [F.transform(starts(n), run(n)) for n in range(2, longest + 1)]
    return F.concat(tokens, *longer) if longer else tokens


def bucketed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, buckets): the bucket of each feature, its unsigned CRC-32 modulo ``buckets``."""
    rows = docs.select(id_col, words(F.coalesce(text_col, F.lit(""))).alias("_words"))
    made = F.transform(features(F.col("_words"), longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return rows.select(id_col, F.size("_words").alias("n_words"), made.alias("buckets"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs. As many numbers as buckets come to the driver."""
    found = rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()
    out = [0] * buckets
    for b, n in found:
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(UNIT * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) for each of B buckets, in doubles."""
    every, wanted = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(UNIT * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(source, target, strict=True)]


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor of the scaled Gumbel noise of an id: -ln(-ln(u)), u from the first 8 hexadecimal digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log(u))).cast("long")


def scored(rows: DataFrame, gain: list[int], id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score) from rows of ``bucketed``; the weight is the mean gain, floored."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # the optimizer makes one literal of it
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size("buckets").cast("long")
    # Floor, where integer division goes towards zero.
    mean = let(total, lambda t: F.when(n > 0, F.call_function("div", t - F.pmod(t, F.nullif(n, F.lit(0).cast("long"))), F.nullif(n, F.lit(0).cast("long")))).otherwise(0))
    rows = rows.select(id_col, "n_words", n.alias("n_features"), mean.cast("long").alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col(id_col), seed))


def drawn(rows: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with their rank (null: not drawn): the highest scores of a percentage of the rows with enough words, ties to the smaller id.

    ``rows`` is read three times and should be a written table. Of all rows only counts of scores are shuffled.
    """
    able = F.col("n_words") >= least_words
    counted = rows.where(able).groupBy("score").agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(F.lit(0)))
    begun = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))) - F.col("_c")
    limit = F.call_function("div", total * percent, F.lit(100).cast("long"))
    starts = counted.select(F.col("score").alias("_score"), begun.alias("_before"), limit.alias("_limit")).where("_before < _limit")
    # As long as the range of scores at most, which gains and noise bound.
    marked = rows.join(F.broadcast(starts), (F.col("score") == F.col("_score")) & able, "left").drop("_score")
    own = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    ranked = marked.where("_before is not null").withColumn("_r", F.col("_before") + F.row_number().over(own))
    rank = F.when(F.col("_r") <= F.col("_limit"), F.col("_r")).cast("long")
    return ranked.withColumn("rank", rank).drop("_before", "_limit", "_r").unionByName(marked.where("_before is null").withColumn("rank", F.lit(None).cast("long")).drop("_before", "_limit"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (id, n_features, weight, score, rank), one for each row of ``docs``; ``target`` has a column ``text``."""
    rows = written(bucketed(docs, id_col, text_col, longest, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(0).alias("_id"), F.col("text").alias("_text")), "_id", "_text", longest, buckets)
    table = gains(totals(rows, buckets), totals(wanted, buckets))
    found = drawn(written(scored(rows, table, id_col, seed), "scores"), id_col, percent, least_words)
    return found.select(id_col, "n_features", "weight", "score", "rank")

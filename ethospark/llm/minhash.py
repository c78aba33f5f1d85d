"""One-permutation MinHash fingerprints with DataFrame functions only.

A text's shingles are hashed once. The high bits of a hash are its bin, the rest its value; each bin keeps its least
value. Sorting the hashes with one sentinel for each bin and keeping the first of each bin gives the bins in order,
the empty ones with their sentinel. An empty bin is filled by optimal densification: it takes the value of the first
non-empty bin in an order that depends on the empty bin alone (some hashed places, then the non-empty bin of least
hash), so equal sets fill alike and the collision probability stays the similarity. The low bits of the values, packed, are the fingerprint; the share of agreeing
bins is corrected for chance agreement of so few bits.

Everything is an expression on a row: nothing is exploded or shuffled, and no group exists that could be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import let

BINS = 256
#: Low-order bits kept of each bin's value: two hexadecimal digits.
BITS = 8
SHINGLE = 5
#: Hashed places that an empty bin tries before it takes the non-empty bin of least hash.
TRIES = 8
NULL_ID = -(2**63)
#: Bytes of text in a range of ids, and ranges, at most: their bounds are literals.
RANGE_BYTES, MAX_RANGES = 32 << 20, 10_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """64-bit hashes of the word shingles of a text, none if it has no word; fewer words are a single shingle."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rolled(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n > 0, F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n < shingle, whole).otherwise(F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def bin_values(hashes: Column, bins: int = BINS) -> Column:
    """The least value of each bin, empty bins filled; an empty array for a text without shingles."""
    shift = 64 - (bins - 1).bit_length()
    top = 1 << (shift - 1)  # values have one bit less, so that the sentinel is behind all of them
    bin_of = lambda x: F.shiftright(x, shift) + bins // 2
    sentinels = F.array(*[F.lit((b - bins // 2 << shift) + (1 << shift) - 1).cast("long") for b in range(bins)])
    low = lambda x: F.shiftleft(F.shiftright(x, shift), shift) + F.shiftrightunsigned(F.shiftleft(x, 64 - shift), 65 - shift)
    value = lambda x: x.bitwiseAND(F.lit((1 << shift) - 1))
    empty = lambda x: value(x) >= top

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def filled(b: Column) -> Column:
        def fill(full: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                tried = F.aggregate(
                    F.sequence(F.lit(1), F.lit(TRIES)),
                    F.lit(None).cast("long"),
                    lambda got, t: F.coalesce(got, let(F.get(b, F.pmod(F.xxhash64(j, t), F.lit(bins)).cast("int")), lambda y: F.when(~empty(y), value(y)))),
                )
                least = F.array_min(F.transform(full, lambda y: F.struct(F.xxhash64(j, bin_of(y)).alias("h"), value(y).alias("v"))))["v"]
                return F.when(~empty(x), value(x)).otherwise(F.coalesce(tried, least))

            return F.transform(b, one)

        return let(F.filter(b, lambda x: ~empty(x)), fill)

    sorted_ = lambda h: F.sort_array(F.concat(F.transform(h, low), sentinels))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(let(sorted_(hashes), firsts), filled))


def lanes(text: Column, bins: int = BINS, shingle: int = SHINGLE) -> Column:
    """The low-order bits of each bin, a byte each; empty for a text without words. A null text counts as empty."""
    values = let(shingle_hashes(F.coalesce(text, F.lit("")), shingle), lambda h: bin_values(h, bins))
    return F.transform(values, lambda v: (v.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << BITS - 1)).cast("tinyint"))


def packed(lanes: Column) -> Column:
    """The fingerprint as hexadecimal digits, two for each bin."""
    return F.lower(F.array_join(F.transform(lanes, lambda v: F.substring(F.hex(v.cast("long") + 512 + (1 << BITS - 1)), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints (lanes): the share m of equal bins without chance, (m - c) / (1 - c), c = 2^-bits.

    Two texts without words are alike (1); a text with and one without words are not (0).
    """
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    share = F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def with_next(docs: DataFrame, id_col: str = "doc_id", groups: int = 0) -> DataFrame:
    """Rows (id, text, lanes, next_text, next_lanes): each row with the next one in id order, after the last the first.

    Rows are dealt into ranges of ids, more of them the more text there is, each ordered by itself, so that no task sees all rows; the
    first row of each range is handed to the range before it, by a join on the range that the rows are dealt by already. Null ids come first; equal ids are ordered by text; null texts are empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if not groups:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups = min(MAX_RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    # As many cuts as ranges; only these few numbers come to the driver.
    cuts = docs.agg(F.percentile_approx("id", [k / groups for k in range(1, groups)], F.lit(10000)).alias("cuts")).first()["cuts"] or []
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    dealt = docs.withColumn("range", F.size(F.filter(cuts, lambda c: c <= F.col("id"))))
    # A row for each range: its least id and the text of that row. Bounded by the number of ranges.
    firsts = dealt.groupBy("range").agg(F.min("id").alias("first_id"))
    texts = dealt.join(F.broadcast(firsts.withColumnRenamed("first_id", "id")), ["range", "id"]).groupBy("range").agg(F.min("text").alias("text"))
    ranges = Window.orderBy("range")
    around = F.first("text").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = texts.select("range", F.coalesce(F.lead("text").over(ranges), around).alias("text")).select("range", F.struct("text", lanes(F.col("text")).alias("lanes")).alias("after"))
    inside = Window.partitionBy("range").orderBy("id", "text")
    ahead = dealt.withColumn("lanes", lanes(F.col("text"))).withColumn("next", F.lead(F.struct("text", "lanes")).over(inside))
    both = ahead.join(after, "range").withColumn("next", F.coalesce("next", "after"))
    return both.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "text", "lanes", F.col("next.text").alias("next_text"), F.col("next.lanes").alias("next_lanes"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last quarter of code points (rounded down) gives way to the first as many of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike it is to that and to the next row."""
    rows = with_next(docs, id_col).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edit_lanes", lanes(F.col("edit")))
    return rows.select(
        id_col,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("lanes")).alias("fingerprint"),
        packed(F.col("edit_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edit_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )

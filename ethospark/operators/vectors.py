"""Embeddings: nearest neighbours, votes, prototypes and retrieval metrics."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.joins import in_many_tasks

#: Rows of a block of queries or of the gallery.
BLOCK = 8192
#: The same where a pair of blocks gives few rows for each row, and there are more than eight of the others.
WIDE = 32768
#: Rows that a pair of blocks gives, about.
FOUND = 1_000_000
#: Queries of a block that is ranked against the whole gallery, and similarities that are held at once.
QUERIES, HELD = 1024, 16_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_k(queries: DataFrame, gallery: DataFrame, k: int, vec: str = "embedding", query_id: str = "query_id", gallery_id: str = "gallery_id") -> DataFrame:
    """Rows (query_id, gallery_id, similarity, rank): the ``k`` most similar gallery rows of each query, itself left out; ties by gallery id.

    Both sides are dealt into blocks of ``BLOCK`` rows, and every pair of blocks is a task of its own: one product of two
    matrices, of which each query's best ``k`` leave the task. Nothing is collected or broadcast, and no task grows with the tables.
    """
    n_queries, n_gallery = queries.count(), gallery.count()
    # A task's result has the best of each of its queries: the more of them are asked for, the fewer queries a block has.
    blocks = [max(1, -(-n_queries // max(1, min(BLOCK, FOUND // max(1, min(k, BLOCK, n_gallery)))))), max(1, -(-n_gallery // BLOCK))]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(query_id, F.col(vec).alias("v")).withColumn("_q", own(query_id, blocks[0])).withColumn("_g", each(blocks[1]))
    right = gallery.select(gallery_id, F.col(vec).alias("v")).withColumn("_g", own(gallery_id, blocks[1])).withColumn("_q", each(blocks[0]))
    kinds = [queries.schema[query_id].dataType.simpleString(), gallery.schema[gallery_id].dataType.simpleString()]

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        m = np.stack(frame["v"].map(lambda x: np.asarray(x, np.float64)).tolist())
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [query_id, gallery_id, "similarity"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values(gallery_id).reset_index(drop=True)
        ids, other, names_ = b[gallery_id].to_numpy(), matrix(b).T, a[query_id].to_numpy()
        out = []
        for start in range(0, len(a), 256):
            near = matrix(a.iloc[start : start + 256]) @ other
            for q, row in zip(names_[start : start + 256], near, strict=True):
                order = np.argsort(-row, kind="stable")
                order = order[ids[order] != q][:k]
                out.append((np.full(len(order), q, names_.dtype), ids[order], row[order]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    pairs = left.groupBy("_q", "_g").cogroup(right.groupBy("_q", "_g"))
    found = pairs.applyInPandas(run, f"`{query_id}` {kinds[0]}, `{gallery_id}` {kinds[1]}, similarity double")
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(gallery_id))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def squared(a: Column, b: Column) -> Column:
    """The squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(left: DataFrame, right: DataFrame, k: int, vec: str = "v", left_id: str = "i", right_id: str = "j") -> DataFrame:
    """Rows (left_id, right_id, d2, r): the ``k`` rows of ``right`` at the least squared distance, r from 0, ties by id; and a row without right_id and r, whose d2 is the largest distance.

    A row is its own neighbour where both tables have it. Pairs of blocks as in ``top_k``, larger ones of many rows: a product of matrices in single precision finds, within its error, the
    rows that can be among the nearest or be the farthest, whose distances are then summed up from the differences, so that equal vectors are at exactly 0.
    """
    blocks = [max(1, -(-n // WIDE), min(-(-n // BLOCK), 8)) for n in (left.count(), right.count())]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select(F.col(left_id).cast("long").alias("i"), F.col(vec).alias("v")).withColumn("_a", own("i", blocks[0])).withColumn("_b", each(blocks[1]))
    b = right.select(F.col(right_id).cast("long").alias("j"), F.col(vec).alias("v")).withColumn("_b", own("j", blocks[1])).withColumn("_a", each(blocks[0]))

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(other):
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in zip(("i", "j", "d2"), ("int64", "Int64", "float64"), strict=True)})
        x, y = (np.stack([np.asarray(v, np.float64) for v in f["v"]]) for f in (one, other))
        mine, ids = one["i"].to_numpy(), other["j"].to_numpy()
        out = [(mine[rows], pd.array(ids[at], "Int64") if near else pd.array([None] * len(rows), "Int64"), far) for rows, at, far, near in _nearest(x, y, ids, k)]
        return pd.DataFrame({"i": np.concatenate([o[0] for o in out]), "j": pd.concat([pd.Series(o[1]) for o in out], ignore_index=True), "d2": np.concatenate([o[2] for o in out])})

    a, b = in_many_tasks(a, ["_a", "_b"]), in_many_tasks(b, ["_a", "_b"])
    found = a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(run, "i long, j long, d2 double")
    # Both come from one window, as the distances would be worked out twice otherwise.
    farthest = F.col("j").isNull()
    w = Window.partitionBy("i", farthest).orderBy(F.when(farthest, -F.col("d2")).otherwise(F.col("d2")), "j")
    ranked = found.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < F.when(farthest, 1).otherwise(k))
    return ranked.withColumn("r", F.when(~farthest, F.col("r"))).toDF(left_id, right_id, "d2", "r")


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Yields arrays (row of ``x``, row of ``y``, squared distance) of the ``k`` nearest of each row, ties by ``ids``, and of its farthest, with True and False."""
    most, size, own = min(k, len(y)), (y * y).sum(axis=1), (x * x).sum(axis=1)
    top = max(own.max(), size.max())
    kind = np.float32 if 1e-20 < top < 1e30 else np.float64
    low, size = (-2 * y.T).astype(kind), size.astype(kind)
    # What the rounded product can be off by, for each row.
    off = (8 * (x.shape[1] + 8) * np.finfo(kind).eps * (own + top)).astype(kind)
    first = max(most, len(y) // 8)  # a bound from some columns holds for all
    for start in range(0, len(x), 64):
        part = x[start : start + 64]
        about, slack = part.astype(kind) @ low, 2 * off[start : start + 64, None]  # but for the row's own size
        about += size
        bound = np.partition(about[:, :first], most - 1, axis=1)[:, most - 1 : most]
        able = about <= bound + slack
        ends = about >= about.max(axis=1, keepdims=True) - slack
        for cells, near in ((able, True), (ends, False)):
            rows, at = np.divmod(np.flatnonzero(cells), len(y))
            far = ((y[at] - part[rows]) ** 2).sum(axis=1)
            order = np.lexsort((ids[at], far if near else -far, rows))
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows come in order
            best = order[place < (most if near else 1)]
            yield rows[best] + start, at[best], far[best], near


def vote(df: DataFrame, keys: list[str], label: str, order: str | None = None) -> DataFrame:
    """Rows (keys, label, count, share, rank): labels by votes; ties by first appearance (``order``) or by name."""
    first = F.min(order) if order else F.min(label)
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("count"), first.alias("_first"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("count").desc(), F.col("_first"), F.col(label))))
    return ranked.drop("_first")


def mean_vector(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """The element-wise mean of each key's vectors. Elements are averaged apart, so a hot key has no list in one task."""
    cells = df.select(*keys, F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vec))


def prototypes(df: DataFrame, keys: list[str], order: str, vec: str, k: int) -> DataFrame:
    """Unit means of the first and the last ``k`` vectors of each key."""
    w = Window.partitionBy(*keys)
    n = df.withColumn("_up", F.row_number().over(w.orderBy(F.col(order)))).withColumn("_down", F.row_number().over(w.orderBy(F.col(order).desc())))
    head, tail = (mean_vector(n.where(F.col(c) <= k), keys, vec).select(*keys, unit(F.col(vec)).alias(name)) for c, name in (("_up", "head"), ("_down", "tail")))
    return head.join(tail, keys)


def retrieval(ranked: DataFrame, match: str = "match", query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, first_hit, ap) from all ranked gallery rows of each query: the rank of the first match and the average precision."""
    w = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranked.withColumn("_hits", F.sum(F.col(match).cast("int")).over(w)).where(F.col(match))
    return hits.groupBy(query_id).agg(F.min("rank").alias("first_hit"), F.avg(F.col("_hits") / F.col("rank")).alias("ap"))


class _Ranks:
    """The queries of a block, and the gallery as it comes, in order of its ids: vectors of length one and codes, in files of the task."""

    def __init__(self) -> None:
        self.asked: list[tuple] = []
        self.vectors, self.codes, self.n, self.width = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0, 0  # noqa: SIM115

    def add(self, side: int, rows: pa.RecordBatch) -> None:
        there = rows.column("v").is_valid().to_numpy(zero_copy_only=False)
        flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = np.zeros((len(there), len(flat) // max(1, int(there.sum()))))
        m[there] = flat.reshape(int(there.sum()), m.shape[1])
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m /= np.maximum(size, 1e-300)
        # A row without a vector is after all others, one whose similarity isn't a number before them, as in a descending order of SQL.
        edge = np.where(~there, -1, np.where(size[:, 0] == 0, 1, 0))
        known = [rows.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("label", "source")]
        label, source = (rows.column(c).fill_null(0).to_numpy() for c in ("label", "source"))
        codes = np.stack([rows.column("i").to_numpy(), label, known[0], source, known[1], edge], axis=1).astype(np.int64)
        if side == 0:
            self.asked += zip(m, codes.tolist(), strict=True)
        elif len(m):
            if there.any() and not self.width:  # rows without a vector came first
                self.width = m.shape[1]
                np.zeros((self.n, self.width)).tofile(self.vectors)
            (m if there.any() else np.zeros((len(m), self.width))).tofile(self.vectors)
            codes.tofile(self.codes)
            self.n += len(m)

    def found(self, sourced: bool) -> Iterator[tuple[int, int, float]]:
        """(id, rank of the first match, average precision) of each query that has a match, a few queries at a time."""
        if not self.n or not self.asked:
            return
        for f in (self.vectors, self.codes):
            f.flush()
        at = np.memmap(self.vectors, np.float64, "r").reshape(self.n, -1) if self.width else np.zeros((self.n, 0))
        ids, label, labelled, source, has_source, edge = np.memmap(self.codes, np.int64, "r").reshape(self.n, -1).T
        labelled, has_source, edges = labelled.astype(bool), has_source.astype(bool), np.flatnonzero(edge)
        step = max(1, HELD // self.n)
        for k in range(0, len(self.asked), step):
            some = self.asked[k : k + step]
            near = np.empty((len(some), self.n))
            for lo in range(0, self.n, BLOCK):
                part = at[lo : lo + BLOCK]
                near[:, lo : lo + BLOCK] = np.stack([v if len(v) == self.width else np.zeros(self.width) for v, _ in some]) @ part.T
            for row, (_, (q, mine, have, day, dated, own_edge)) in zip(near, some, strict=True):
                row[edges] = np.where(edge[edges] < 0, -np.inf, np.inf)
                if own_edge:
                    row[:] = np.where(edge < 0, -np.inf, np.inf) if own_edge > 0 else -np.inf
                kept = ids != q
                if sourced:  # gone is what isn't known to differ in either
                    kept &= (labelled & bool(have) & (label != mine)) | (has_source & bool(dated) & (source != day))
                match = kept & labelled & (label == mine) if have else np.zeros(self.n, bool)
                if not match.any():
                    continue
                rank = _match_ranks(row, match, kept & ~match)
                yield q, int(rank[0]), float((np.arange(1, len(rank) + 1) / rank).mean())


def _match_ranks(row: np.ndarray, match: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The ranks, in ascending order, of the ``match`` rows among these and ``others``: by descending values, equal ones in their order."""
    hits = -np.sort(-row[match])
    rest = np.sort(row[others])
    above = len(rest) - np.searchsorted(rest, hits, "right")
    if (np.searchsorted(rest, hits, "left") + above != len(rest)).any():  # a match and another row are equal: their order counts
        at = np.flatnonzero(match | others)
        at = at[np.argsort(-row[at], kind="stable")]
        return np.flatnonzero(match[at]) + 1
    return above + np.arange(1, len(hits) + 1)


def full_retrieval(queries: DataFrame, gallery: DataFrame, label: str, vec: str = "embedding", query_id: str = "query_id", gallery_id: str = "gallery_id", source: str | None = None) -> DataFrame:
    """Rows (query_id, first_hit, ap): what ``retrieval`` gives for all gallery rows of each query, itself left out, ranked by cosine similarity (ties by gallery id).

    A match has the query's ``label``; with ``source``, rows of its label and its source are left out before. Queries without a match have no row. Ids are integers, unique in
    their table. A block of ``QUERIES`` queries is a task's group, to which the gallery comes in order of its ids: the shuffle has a gallery row once for each block, and neither similarities nor ranks
    leave their task. It keeps the gallery in a file of its own and holds ``HELD`` similarities, or those of one query.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).otherwise(F.lit(None).cast("long")) if c else F.lit(None).cast("long")

    def rows(df: DataFrame, name: str, block: Column, side: int) -> DataFrame:
        return df.where(F.col(name).isNotNull()).select(block.alias("block"), F.lit(side).alias("side"), F.col(name).cast("long").alias("i"), F.col(vec).alias("v"), code(label).alias("label"), code(source).alias("source"))

    ask = rows(queries, query_id, F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"), 0)
    held = rows(gallery, gallery_id, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), 1)
    names = [query_id, "first_hit", "ap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, queries first."""
        block, ranks = None, _Ranks()

        def done() -> pa.RecordBatch:
            found = list(ranks.found(source is not None))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("block", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if block is not None and at[lo, 0] != block:
                    yield done()
                    ranks = _Ranks()
                block = at[lo, 0]
                ranks.add(int(at[lo, 1]), batch.slice(lo, hi - lo))
        yield done()

    both = ask.unionByName(held).repartition(2 * blocks, "block").sortWithinPartitions("block", "side", "i")
    return both.mapInArrow(run, f"`{query_id}` long, first_hit long, ap double")


def cmc(found: DataFrame, most: int) -> DataFrame:
    """Share of the queries whose first match is at rank k or before, for each k."""
    total = found.count()
    ranks = found.sparkSession.range(1, most + 1).withColumnRenamed("id", "k")
    counts = found.groupBy(F.col("first_hit").cast("long").alias("k")).agg(F.count("*").alias("n"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.join(counts, "k", "left").select("k", (F.coalesce(F.sum("n").over(w), F.lit(0)) / F.lit(float(max(1, total)))).alias("share"))

"""SimHash near-duplicates: fingerprints, exact comparison in tiles, connected components.

Fingerprints are computed once per row (``mapInArrow``, numpy) and equal ones are merged before any comparison.

Candidates: a fingerprint of ``bits`` bits is cut into blocks. By the pigeonhole principle two fingerprints at
distance ``radius`` or less agree on at least one of ``radius + 1`` blocks, so rows that share a block's value form a
bucket and no pair is lost. A bucket with more than ``TILE`` rows is cut into tiles, and every pair of its tiles is a
task of its own, so no task gets an unbounded group.

Within a bucket rows are sorted by population count and compared tile by tile with numpy's exclusive-or and bit
count; two tiles are skipped if their population counts differ by more than the radius, as the distance of two words
is at least the difference of their counts. Of the pairs found only a spanning forest leaves the task, never all
pairs of a group.

Components come from rounds of large-star and small-star over the links, with the lineage cut in every round. Only
fingerprints and links move; texts never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import binary, join_split, map_batches, written

TILE = 4096
#: Buckets up to this size are compared as integers.
FEW = 24
SEED = 42


def fingerprint(text: bytes, shingle: int = 3, bits: int = 64) -> np.ndarray:
    """The SimHash of one text as ``bits / 64`` unsigned words, highest bit first.

    A-Z are lowered; words are runs of bytes other than ASCII white space; shingles count as often as they occur. A
    text with fewer words is a single shingle; without any word the fingerprint is zero. A bit is set if it is in more
    than half of the shingles' XXH64 values (seed 42 for the first 64 bits, 43 for the next and so on).
    """
    words = text.lower().split()
    lanes = bits // 64
    if not words:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    n = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    pieces = [joined[starts[i] : starts[i + width] - 1] for i in range(n)]
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        digest = xxhash.xxh64_intdigest
        values = np.array([digest(p, SEED + lane) for p in pieces], ">u8")
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 65536):
            ones += np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > n).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """Rows (id, fp binary): the fingerprint of each row's whole text, as big-endian bytes. A null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(id_col, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, bits).astype(">u8").tobytes() for t in binary(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)).cast(schema.types[0]), pa.array(fps, pa.binary())], schema=schema)

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp binary")


def near_pairs(fps: np.ndarray, radius: int, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i <= j in the order of population counts, of rows of ``fps`` (n, lanes) at distance ``radius`` or less, tile by tile."""
    count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order]
    for a in range(0, len(fps), tile):
        left, last = fps[a : a + tile], count[min(a + tile, len(fps)) - 1]
        for b in range(a, len(fps), tile):
            if count[b] - last > radius:
                break  # this tile and all later ones differ by more than the radius
            right = fps[b : b + tile]
            far = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]).astype(np.int16)
            for lane in range(1, fps.shape[1]):
                far += np.bitwise_count(left[:, None, lane] ^ right[None, :, lane])
            i, j = np.nonzero(far <= radius)
            yield order[i + a], order[j + b]


def linked(fps: np.ndarray, radius: int, tile: int = 512) -> np.ndarray:
    """For each row of ``fps`` (n, lanes) one row that all rows have in common which links of distance ``radius`` or less reach."""
    label = np.arange(len(fps))
    for i, j in near_pairs(fps, radius, tile):
        while len(i):
            i, j = (x[label[i] != label[j]] for x in (i, j))
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while (up := label[label]).tolist() != label.tolist():
                label = up
    return label


def links(distinct: DataFrame, radius: int = 3, bits: int = 64, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join all rows (id, fp) at distance ``radius`` or less; in each bucket a forest of stars.

    ``distinct`` has one row for each fingerprint. With ``radius + 1`` blocks or more no pair is lost; fewer blocks
    have longer keys and smaller buckets and miss pairs that differ in every block.
    """
    digits = bits // 4 // (blocks or radius + 1)
    keys = F.array(*[F.concat(F.lit(f"{k}:"), F.substring(F.hex("fp"), k * digits + 1, digits)) for k in range(bits // 4 // digits)])
    rows = distinct.select("id", "fp", F.explode(keys).alias("key"))
    # Buckets that need tiles are few and are joined in; all other rows have one tile.
    large = rows.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = rows.join(large, "key", "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).otherwise(0))
    others = F.filter(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: (t != F.col("tile")) | (F.coalesce("tiles", F.lit(1)) == 1))
    pairs = F.transform(others, lambda t: F.struct(F.least(t, F.col("tile")).alias("lo"), F.greatest(t, F.col("tile")).alias("hi")))
    dealt = rows.select("key", "id", "fp", F.explode(pairs).alias("pair")).select("key", "pair.lo", "pair.hi", "id", "fp")

    def group(ids: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        if len(ids) > FEW:
            to = linked(fps, radius)
            return [(int(ids[i]), int(ids[to[i]])) for i in np.flatnonzero(to != np.arange(len(ids)))]
        words, label, found = [int.from_bytes(x.astype(">u8").tobytes()) for x in fps], list(range(len(ids))), []
        for i in range(1, len(words)):
            for j in range(i):
                if label[i] != label[j] and (words[i] ^ words[j]).bit_count() <= radius:
                    found.append((int(ids[i]), int(ids[j])))
                    label = [label[j] if x == label[i] else x for x in label]
        return found

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for its other rows in the next one."""
        held: pa.Table | None = None
        for batch in _then_none(batches):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows < 65536:
                    continue
            if held is None or not held.num_rows:
                continue
            key = held.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cuts[1:], len(key))
            if batch is not None:
                cuts, ends = cuts[:-1], ends[:-1]
            ids = held.column("id").to_numpy()
            fps = np.frombuffer(b"".join(held.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(len(key), -1)
            out = [x for i, j in zip(cuts.tolist(), ends.tolist(), strict=True) if j - i > 1 for x in group(ids[i:j], fps[i:j])]
            held = held.slice(int(ends[-1]) if len(ends) else 0)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    # A bucket with a single row has nothing to compare and needn't reach Python.
    several = rows.groupBy("key").count().where("count > 1").select("key")
    tasks = dealt.join(several, "key", "left_semi").select(F.xxhash64("key", "lo", "hi").alias("bucket"), "id", "fp")
    return map_batches(tasks.repartition("bucket").sortWithinPartitions("bucket"), run, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root): for each id in ``edges`` (a, b) the smallest id that can be reached.

    Rounds go on until nothing changes. Large-star hangs all larger neighbours of a node onto its least one, small-star the smaller ones; a few rounds
    make stars. Each step is a grouped minimum, merged before the shuffle, and a join that deals the links of a hub to several tasks.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("rows")), "least")
        large = join_split(both, least, "a", "rows").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")), "least")
        small = join_split(large, least, "a", "rows").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(small, "edges")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    # Stars have no row of their own centre.
    return edges.union(edges.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bits: int = 64, blocks: int | None = None) -> DataFrame:
    """Rows (doc_id, fp binary, component_id) for each row of ``docs``; ids are integers.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id that can be reached,
    the row's own included. Rows with a null id have a fingerprint like any other: it links and bridges, and their ``component_id`` is null
    only where no row of the component has an id. Rows of one id are told apart by their fingerprints. Texts without words have the fingerprint zero and are linked like any other.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, bits).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    # Each distinct fingerprint is a node of its own, numbered as it is written, so ids needn't be there or differ.
    counted = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    counted = written(counted.withColumn("id", F.monotonically_increasing_id()), "distinct")
    roots = components(links(counted.select("fp", "id"), radius, bits, blocks))
    linked_, alone = counted.join(roots, "id"), counted.join(roots, "id", "left_anti")
    placed = written(linked_.select("fp", "least", "rows", "root"), "placed")
    sizes = written(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    named = join_split(placed, sizes, "root", "n").select("fp", "component_id", "rows").union(alone.select("fp", "least", "rows"))
    return join_split(fps, written(named, "named"), "fp", "rows", "left").select("doc_id", "fp", "component_id")

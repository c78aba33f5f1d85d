"""Smoothing of label sequences: rolling majorities, fills, spikes, iterated merges.

Windows of time are range frames over microseconds. A majority needs one conditional count for each label, so the
list of labels is a parameter; all counts share one window, hence one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.islands import label_runs


def around(keys: list[str], us: str, before: int, after: int):
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(-before, after)


def winner(counts: list[Column], labels: list[str]) -> Column:
    """The label of the highest count; of equal ones the first in the list's order. Null if all are zero."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.when(most > 0, F.coalesce(*[F.when(c == most, F.lit(x)) for c, x in zip(counts, labels, strict=True)]))


def rolling_majority(df: DataFrame, keys: list[str], us: str, label: str, labels: list[str], half: int, least: int, invalid: str, out: str = "smoothed") -> DataFrame:
    """The most frequent valid label within ``half`` on either side.

    Windows of fewer than ``least`` rows (invalid ones count) leave the label; windows without a valid label give ``invalid``;
    ties go to the alphabetically first label.
    """
    w, names = around(keys, us, half, half), sorted(labels)
    counts = [F.sum((F.col(label) == x).cast("int")).over(w) for x in names]
    df = df.withColumn("_n", F.count("*").over(w))
    for n, c in enumerate(counts):
        df = df.withColumn(f"_c{n}", c)
    chosen = F.coalesce(winner([F.col(f"_c{n}") for n in range(len(names))], names), F.lit(invalid))
    return df.withColumn(out, F.when(F.col("_n") < least, F.col(label)).otherwise(chosen)).drop("_n", *[f"_c{n}" for n in range(len(names))])


def fill_from_window(df: DataFrame, keys: list[str], us: str, label: str, labels: list[str], half: int, invalid: str, out: str = "filled") -> DataFrame:
    """Invalid rows take the most frequent valid label around them, or stay."""
    w, names = around(keys, us, half, half), sorted(labels)
    chosen = winner([F.sum((F.col(label) == x).cast("int")).over(w) for x in names], names)
    return df.withColumn(out, F.when(F.col(label) == invalid, F.coalesce(chosen, F.col(label))).otherwise(F.col(label)))


def fill_from_last(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, age: int, invalid: str, default: str, out: str = "filled") -> DataFrame:
    """Invalid rows take the last valid label if it is ``age`` old at most, and a default otherwise."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(label) != invalid, F.struct(F.col(us).alias("us"), F.col(label).alias("label"))), ignorenulls=True).over(w)
    df = df.withColumn("_last", last)
    found = F.when(F.col(us) - F.col("_last.us") <= age, F.col("_last.label")).otherwise(F.lit(default))
    return df.withColumn(out, F.when(F.col(label) == invalid, found).otherwise(F.col(label))).drop("_last")


def remove_spikes(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, most: int, out: str = "smoothed") -> DataFrame:
    """Runs of ``most`` rows or fewer between two runs of one other label take that label."""
    runs = label_runs(df, keys, us, order, label)
    spans = runs.groupBy(*keys, "run").agg(F.first(label).alias("_own"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("run")
    spans = spans.withColumn("_left", F.lag("_own").over(w)).withColumn("_right", F.lead("_own").over(w))
    short = (F.col("_n") <= most) & (F.col("_left") == F.col("_right"))
    decided = spans.select(*keys, "run", F.when(short, F.col("_left")).otherwise(F.col("_own")).alias(out))
    return runs.join(decided, [*keys, "run"]).drop("run")


def dominant_when_seen_twice(df: DataFrame, keys: list[str], label: str, dominant: str, source: str, out: str = "smoothed") -> DataFrame:
    """Where two sources or more see a subject at a time and one says ``dominant``, all rows say so."""
    groups = df.groupBy(*keys).agg(F.max((F.col(label) == dominant).cast("int")).alias("_any"), F.min(source).alias("_a"), F.max(source).alias("_b"))
    joined = df.join(groups, keys)
    return joined.withColumn(out, F.when((F.col("_any") == 1) & (F.col("_a") < F.col("_b")), F.lit(dominant)).otherwise(F.col(label))).drop("_any", "_a", "_b")


def fix_identity_switches(df: DataFrame, keys: list[str], us: str, identity: str, identities: list[int], half: int, out: str = "fixed") -> DataFrame:
    """A row that is alone at its time takes the identity that dominates around it, if that is another one.

    Dominant: more rows than the row's own identity within ``half`` on either side; the least of equally frequent ones.
    A row counts from ``half`` before it to ``half`` after it, so counts are running sums over the rows' begins and ends, whatever the number of rows in a window.
    The time is cut into parts of many windows, and a row counts in each part that it reaches, so no task sees all rows of a key.
    """
    width = 32 * half
    part = lambda c: F.floor(c / width)
    marked = df.withColumn("_alone", F.count("*").over(Window.partitionBy(*keys, us)))
    dealt = marked.withColumn("_part", F.explode(F.coalesce(F.sequence(part(F.col(us) - half), part(F.col(us) + half)), F.array(F.lit(None).cast("long")))))
    mark = lambda at, kind: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"))
    marks = F.array(mark(F.greatest(F.when(F.col(us).isNotNull(), F.col("_part") * width), F.col(us) - half), 0), mark(F.col(us), 1), mark(F.col(us) + half, 2))
    dealt = dealt.withColumn("_mark", F.explode(marks)).where((F.col("_mark.kind") != 1) | F.col("_part").eqNullSafe(part(F.col(us))))
    w = Window.partitionBy(*keys, "_part").orderBy("_mark.at", "_mark.kind").rowsBetween(Window.unboundedPreceding, 0)
    step = F.lit(1) - F.col("_mark.kind")  # 1, 0, -1
    df = dealt.select("*", *[F.sum(F.when(F.col(identity) == x, step).otherwise(0)).over(w).alias(f"_c{n}") for n, x in enumerate(identities)])
    df = df.where("_mark.kind = 1").drop("_part", "_mark")
    counts = [F.col(f"_c{n}") for n in range(len(identities))]
    own = F.coalesce(*[F.when(F.col(identity) == x, c) for c, x in zip(counts, identities, strict=True)], F.lit(0))
    others = [F.when(F.col(identity) == x, F.lit(0)).otherwise(c) for c, x in zip(counts, identities, strict=True)]
    most = F.greatest(*others)
    best = F.coalesce(*[F.when(c == most, F.lit(x)) for c, x in zip(others, identities, strict=True)])
    switch = (F.col("_alone") == 1) & (most > own)
    return df.withColumn(out, F.when(switch, best).otherwise(F.col(identity))).drop("_alone", *[f"_c{n}" for n in range(len(identities))])


def suppress_isolated(df: DataFrame, keys: list[str], us: str, label: str, sleep: list[str], back: int, ahead: int, share: float, replacement: str, out: str = "smoothed") -> DataFrame:
    """Sleep rows with little sleep before and after (the row itself not counted) become ``replacement``."""
    is_sleep = F.col(label).isin(sleep).cast("int")
    before = Window.partitionBy(*keys).orderBy(us).rangeBetween(-back, -1)
    after = Window.partitionBy(*keys).orderBy(us).rangeBetween(1, ahead)
    quiet = (F.coalesce(F.avg(is_sleep).over(before), F.lit(0.0)) < share) & (F.coalesce(F.avg(is_sleep).over(after), F.lit(0.0)) < share)
    return df.withColumn("_quiet", quiet).withColumn(out, F.when(F.col(label).isin(sleep) & F.col("_quiet"), F.lit(replacement)).otherwise(F.col(label))).drop("_quiet")


def gate_by_confidence(label: Column, confidence: Column, least: float, invalid: str) -> Column:
    return F.when(confidence < least, F.lit(invalid)).otherwise(label)


def gate_by_margin(probabilities: Column, margin: float) -> Column:
    """The place of the greatest of an array of probabilities, 0 if it doesn't lead the second by ``margin``."""
    down = F.sort_array(probabilities, asc=False)
    return F.when(F.get(down, F.lit(0)) - F.get(down, F.lit(1)) >= margin, F.array_position(probabilities, F.get(down, F.lit(0))) - 1).otherwise(F.lit(0)).cast("int")


def outliers(df: DataFrame, keys: list[str], order: list[str], label: str, confidence: str, window: int = 21, sure: float = 0.99, unsure: float = 0.7, share: float = 0.3, name: str = "smoothed") -> DataFrame:
    """``df`` with ``name``: the label, or the commonest one around it where it is an outlier.

    In order, each row looks at the ``window`` // 2 rows to both sides, of which those before it have their new labels already. A row of a confidence below ``unsure``
    (and ``sure``) takes the commonest other label (ties: the least) if that occurs twice or more and its own makes up less than ``share`` of the window. Blocks (``keys``) of fewer rows than
    ``window`` stay as they are. Rows without a confidence stay; null labels stay and don't count.

    The window that numbers the rows puts them in order, and they pass as a stream: a task holds a window of rows, and never a block.
    """
    import pyarrow as pa

    window += 1 - window % 2
    half = window // 2
    at = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(at))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        waiting: list = []  # batches whose labels aren't all settled
        labels, sureness, numbers = [], [], []  # of their rows, after a window of rows before them
        settled = given = 0

        def settle(last: bool) -> None:
            """Goes on as long as a row's window, and whether its block is long enough, is known."""
            nonlocal settled
            while settled < len(labels):
                reach = settled + (half if numbers[settled] >= window else window)
                end = next((j for j in range(settled + 1, min(len(labels), reach + 1)) if numbers[j] == 1), None)
                if end is None:
                    if len(labels) <= reach and not last:
                        return
                    end = min(len(labels), reach + 1)
                if numbers[end - 1] >= window:
                    look(max(0, settled - min(half, numbers[settled] - 1)), settled, min(end, settled + half + 1))
                settled += 1

        def look(a: int, i: int, b: int) -> None:
            c = sureness[i]
            if labels[i] is None or c is None or c >= sure or not c < unsure:
                return
            tally: dict = {}
            for x in labels[a:i] + labels[i + 1 : b]:
                if x is not None:
                    tally[x] = tally.get(x, 0) + 1
            if not tally:
                return
            common = min(tally, key=lambda x: (-tally[x], x))
            if common != labels[i] and tally[common] >= 2 and tally.get(labels[i], 0) / sum(tally.values()) < share:
                labels[i] = common

        def give():
            nonlocal settled, given
            while waiting and given + waiting[0].num_rows <= settled:
                batch = waiting.pop(0)
                n, names = batch.num_rows, [f for f in batch.schema.names if f != "_n"]
                kind = batch.schema.field(label).type
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f)) for f in names], pa.array(labels[given : given + n], kind)], names=[*names, name])
                given += n
                cut = max(0, given - window)
                for held in (labels, sureness, numbers):
                    del held[:cut]
                settled, given = settled - cut, given - cut

        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            waiting.append(batch)
            labels += column(label)
            sureness += column(confidence)
            numbers += column("_n")
            settle(False)
            yield from give()
        settle(True)
        yield from give()

    return numbered.mapInArrow(run, f"{kinds}, `{name}` {df.schema[label].dataType.simpleString()}")


def drop_spurious(df: DataFrame, keys: list[str], us: str, identity: str, least: int, factor: int = 2) -> DataFrame:
    """``df`` without the rows of an identity that is there for less than ``least`` in all, where others have more than ``factor`` times its rows meanwhile.

    Short stays are few and short, so the rows meanwhile are found by buckets of time of that length.
    """
    from ethospark.operators.joins import point_in_interval

    spans = df.groupBy(*keys, identity).agg(F.min(us).alias("_from"), F.max(us).alias("_to"), F.count("*").alias("_own")).where(F.col("_to") - F.col("_from") < least)
    meanwhile = point_in_interval(df.select(*keys, us), spans, keys, us, "_from", "_to", max(least, 1)).groupBy(*keys, identity, "_own").agg(F.count("*").alias("_all"))
    bad = meanwhile.where(F.col("_all") - F.col("_own") > F.col("_own") * factor).select(*keys, identity)
    return df.join(bad, [*keys, identity], "left_anti")

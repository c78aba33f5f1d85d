"""Smoothing in passes, until nothing changes.

A pass that is decided on the labels as they were is a set operation and runs as DataFrame windows and joins, with the
lineage cut after each pass. Rules in which a later decision sees an earlier one run in ``applyInPandas`` on one subject.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.graph import checkpointed
from ethospark.operators.islands import label_runs


def until_settled(df: DataFrame, label: str, one_pass: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Applies ``one_pass``, which puts the new label into ``_label``, until no label changes or ``most`` times."""
    df = checkpointed(df)
    for _ in range(most):
        new = checkpointed(one_pass(df))
        changed = not new.where(~F.col("_label").eqNullSafe(F.col(label))).isEmpty()
        df = new.withColumn(label, F.col("_label")).drop("_label")
        if not changed:
            break
    return df


def majority(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, labels: list[str], half: int, most: int = 10) -> DataFrame:
    """Rolling majority of the valid ``labels`` within ``half`` on either side, repeated; ties go to the label met first in the window."""

    def one(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        w = Window.partitionBy(*keys).orderBy(us).rangeBetween(-half, half)
        for n, x in enumerate(labels):
            hit = F.col(label) == x
            rows = rows.withColumn(f"_c{n}", F.struct(F.count_if(hit).over(w).alias("n"), (-F.min(F.when(hit, F.col("_at"))).over(w)).alias("first"), F.lit(x).alias("x")))
        best = F.array_max(F.array(*[F.col(f"_c{n}") for n in range(len(labels))]))
        return rows.withColumn("_label", F.when(best["n"] > 0, best["x"]).otherwise(F.col(label))).drop("_at", *[f"_c{n}" for n in range(len(labels))])

    return until_settled(df, label, one, most)


def _runs(rows: DataFrame, keys: list[str], us: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    runs = label_runs(rows, keys, us, order, label, name="_run")
    return runs, runs.groupBy(*keys, "_run").agg(F.first(label).alias("_own"), F.min(us).alias("_a"), F.max(us).alias("_b"))


def merge_bouts(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, least: int, invalid: str, most: int = 20) -> DataFrame:
    """Bouts shorter than ``least`` between two bouts of one valid label take it, repeated."""

    def one(rows: DataFrame) -> DataFrame:
        runs, bouts = _runs(rows, keys, us, order, label)
        w = Window.partitionBy(*keys).orderBy("_run")
        before, after = F.lag("_own").over(w), F.lead("_own").over(w)
        bouts = bouts.withColumn("_label", F.when((F.col("_b") - F.col("_a") < least) & (before == after) & (before != invalid), before).otherwise(F.col("_own")))
        return runs.join(bouts.select(*keys, "_run", "_label"), [*keys, "_run"]).drop("_run")

    return until_settled(df, label, one, most)


def dominant_context(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, short: int, half: int, invalid: str, share: float = 0.6, most: int = 20) -> DataFrame:
    """Bouts shorter than ``short`` take the label that fills more than ``share`` of the other bouts within ``half`` of their middle.

    An overlap of no length counts as the bout's own length, and as 0.3 s at least.
    """

    def one(rows: DataFrame) -> DataFrame:
        runs, bouts = _runs(rows, keys, us, order, label)
        middle = (F.col("_a") + F.col("_b")) / 2
        brief = bouts.where(F.col("_b") - F.col("_a") < short).select(*keys, F.col("_run").alias("_mine"), F.col("_own").alias("_was"), (middle - half).alias("_lo"), (middle + half).alias("_hi"))
        width = 2 * half + 1
        cut = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
        near = brief.withColumn("_k", cut(F.col("_lo"), F.col("_hi"))).join(bouts.where(F.col("_own") != invalid).withColumn("_k", cut(F.col("_a"), F.col("_b"))), [*keys, "_k"])
        inside = F.least("_b", "_hi") - F.greatest("_a", "_lo")
        near = near.where((F.col("_mine") != F.col("_run")) & (inside >= 0)).where(F.col("_k") == F.floor(F.greatest("_a", "_lo") / width))
        length = F.when(inside < 10_000, F.greatest(F.lit(300_000), F.col("_b") - F.col("_a"))).otherwise(inside)
        sums = near.groupBy(*keys, "_mine", "_was", "_own").agg(F.sum(length).alias("_d"), F.min("_run").alias("_first"))
        picked = sums.groupBy(*keys, "_mine", "_was").agg(F.sum("_d").alias("_all"), F.max(F.struct(F.col("_d"), (-F.col("_first")).alias("f"), F.col("_own").alias("x"))).alias("_best"))
        picked = picked.where(F.col("_best._d") > share * F.col("_all")).select(*keys, F.col("_mine").alias("_run"), F.col("_best.x").alias("_label"))
        out = runs.join(picked, [*keys, "_run"], "left")
        return out.withColumn("_label", F.coalesce("_label", label)).drop("_run")

    return until_settled(df, label, one, most)


def _per_subject(df: DataFrame, keys: list[str], columns: list[str], change: Callable[[pd.DataFrame], list[str]], label: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(columns, kind="stable")
        frame[label] = change(frame)
        return frame

    return df.groupBy(*keys).applyInPandas(run, schema)


def check_sleep(df: DataFrame, keys: list[str], us: str, order: list[str], label: str, block: str, sleep: list[str], half: int, invalid: str, share: float = 0.5) -> DataFrame:
    """A sleep segment with less than ``share`` sleep around its start and around its end becomes what else is most frequent there.

    Segments are taken in turn, and a later one sees what an earlier one became. Of two sides that differ the left one's label counts.
    """

    def change(frame: pd.DataFrame) -> list[str]:
        at, now = frame[us].to_numpy(), frame[label].to_numpy(object).copy()
        edges = np.flatnonzero((now[1:] != now[:-1]) | (frame[block].to_numpy()[1:] != frame[block].to_numpy()[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(now)], strict=True):
            if now[a] not in sleep:
                continue
            sides = []
            for t in (at[a], at[b - 1]):
                seen = [x for x in now[np.searchsorted(at, t - half) : np.searchsorted(at, t + half, side="right")] if x != invalid]
                awake = [x for x in seen if x not in sleep]
                sides.append((len(seen) - len(awake) >= share * len(seen) if seen else False, max(dict.fromkeys(awake), key=awake.count, default=None)))
            if not any(mainly for mainly, _ in sides):
                now[a:b] = next((x for _, x in sides if x is not None), invalid)
        return now.tolist()

    return _per_subject(df, keys, order, change, label)


def resolve_bouts(bouts: DataFrame, keys: list[str], start: str, end: str, label: str, word: str, gap: int, invalid: str, most: int = 10) -> DataFrame:
    """A bout between two bouts of one other label takes it if they are longer together than twice its length.

    Only labels with ``word`` in them, bouts no farther than ``gap`` from both neighbours; in order and in place, repeated.
    """

    def change(frame: pd.DataFrame) -> list[str]:
        now, a, b = frame[label].tolist(), frame[start].tolist(), frame[end].tolist()
        length = [y - x for x, y in zip(a, b, strict=True)]
        for _ in range(most):
            old = list(now)
            for i in range(1, len(now) - 1):
                fits = now[i - 1] == now[i + 1] != now[i] != invalid and word in now[i] and word in now[i - 1]
                if fits and length[i - 1] + length[i + 1] > 2 * length[i] and max(a[i] - b[i - 1], a[i + 1] - b[i]) <= gap:
                    now[i] = now[i - 1]
            if now == old:
                break
        return now

    return _per_subject(bouts, keys, [start, end], change, label)

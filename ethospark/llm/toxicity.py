"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are the presence of its words and of their beginnings, hashed. One weight vector is shared by all
grades; grade k or worse has the probability sigmoid(w x - theta_k) with ascending thresholds theta. The expected severity is the
sum of these probabilities.

The labels tell toxic from clean only. Grades of toxic rows come from the labelled sample: marker features occur in
toxic rows almost only, and toxic rows are graded 1 to ``GRADES`` by quantiles of the number of markers they have.

The fit uses a bounded sample of labelled rows (``SAMPLE`` of each class and ``SAMPLE_BYTES`` of features, those of least hash), whose
features alone come to the driver. Scoring reads every row once, without a shuffle; the model is a dictionary of the non-zero weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import map_batches, strings, written

#: Labelled rows of each class that the model is fitted on, at most, and bytes of all their features together.
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
GRADES = 3
DIMENSIONS = 1 << 20
#: Lengths of word beginnings that are features besides the whole word.
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
#: Rows are rejected from this probability of grade 1 or worse on.
REJECT = 0.3
#: Words whose features a task remembers.
CACHE = 100_000
#: Features of the fit that are worked on at once: the driver holds them as 32-bit integers, and wider copies of so many only.
CHUNK = 1 << 19


def word_features(word: str) -> tuple[int, ...]:
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh64_intdigest(x) & (DIMENSIONS - 1) for x in names)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Non-zero weights by feature, and the ascending thresholds; without thresholds every severity is 0."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of grade 1 or worse, expected severity and likeliest grade for w x."""
        if not self.thresholds:
            return np.zeros(len(score)), np.zeros(len(score)), np.zeros(len(score), np.int32)
        worse = _sigmoid(score[:, None] - np.array(self.thresholds)[None, :])
        padded = np.concatenate([np.ones((len(score), 1)), worse, np.zeros((len(score), 1))], axis=1)
        return worse[:, 0], worse.sum(axis=1), (padded[:, :-1] - padded[:, 1:]).argmax(axis=1).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _likelihood(z: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its gradients by z and by theta."""
    k = len(theta)
    upper = np.where(y > 0, _sigmoid(z - theta[np.maximum(y - 1, 0)]), 1.0)  # P(grade >= y)
    lower = np.where(y < k, _sigmoid(z - theta[np.minimum(y, k - 1)]), 0.0)  # P(grade > y)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    dz = -(du - dl) / p / len(y)
    dtheta = np.zeros(k)
    np.add.at(dtheta, np.maximum(y - 1, 0), np.where(y > 0, du / p, 0.0) / len(y))
    np.add.at(dtheta, np.minimum(y, k - 1), np.where(y < k, -dl / p, 0.0) / len(y))
    return float(-np.log(p).mean()), dz, dtheta


def grades(features: list[np.ndarray], toxic: np.ndarray, n_grades: int = GRADES, min_rows: int = 5, purity: float = 0.9) -> np.ndarray:
    """0 for clean rows; 1 to ``n_grades`` for toxic rows by quantiles of their number of marker features."""
    size = 1 + max((int(x[-1]) for x in features if len(x)), default=0)
    rows, bad = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for x, y in zip(features, toxic.tolist(), strict=True):  # a row has a feature once
        rows[x] += 1
        bad[x] += y
    marker = (rows >= min_rows) & (bad >= purity * rows)
    markers = np.array([int(marker[x].sum()) for x in features])
    cuts = np.quantile(markers[toxic > 0], [k / n_grades for k in range(1, n_grades)]) if n_grades > 1 else np.zeros(0)
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, markers, side="left"), 0)


def _parts(ends: np.ndarray, most: int | None = None):
    """A function that yields (a, b, row, first, n): the features from a to b are those of the n rows from ``first`` on, ``row`` says whose; ``most`` or one row's at a time."""
    most, cuts = most or CHUNK, [0]
    while cuts[-1] < len(ends) - 1:
        at = cuts[-1]
        cuts.append(max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))

    def parts():
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(ends[i]), int(ends[j]), np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), i, j - i

    return parts


def fit(features: list[np.ndarray], y: np.ndarray, rounds: int = 300, l1: float = 5e-4, min_rows: int = 3) -> Model:
    """Accelerated proximal gradient for the cumulative logit with an L1 penalty on the shared weights."""
    k = int(y.max(initial=0))
    if k == 0 or len(set(y.tolist())) < 2:
        return Model({}, ())
    seen = np.zeros(1 + max((int(x.max()) for x in features if len(x)), default=0), np.int32)
    for x in features:
        np.add.at(seen, x, 1)
    kept = np.flatnonzero(seen >= min_rows)
    place = np.full(len(seen), -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    column = np.empty(int(seen[kept].sum(dtype=np.int64)), np.int32)
    ends = np.zeros(len(features) + 1, np.int64)
    for n, x in enumerate(features):
        mine = place[x]
        mine = mine[mine >= 0]
        ends[n + 1] = ends[n] + len(mine)
        column[ends[n] : ends[n + 1]] = mine
    parts = _parts(ends)
    # A row's features weigh 1 / sqrt(mean size) at most, so that the step's bound is known.
    theta = np.quantile(y, 0.5) + np.linspace(1.0, 2.0, k)
    w, ahead, t = np.zeros(len(kept)), np.zeros(len(kept)), 1.0
    th, th_ahead = theta.copy(), theta.copy()
    bound = float(np.diff(ends).mean())
    step = 16.0 / bound
    last = np.inf
    for _ in range(rounds):
        z = np.concatenate([np.bincount(row, weights=ahead[column[a:b]], minlength=n) for a, b, row, _, n in parts()])
        loss, dz, dtheta = _likelihood(z, y, th_ahead)
        grad = np.zeros(len(kept))
        for a, b, row, first, _ in parts():
            np.add.at(grad, column[a:b], dz[first + row])
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_th = np.sort(th_ahead - min(step * 4, 2.0) * dtheta)
        if loss > last:  # too long a step: start the momentum anew, with a shorter one
            step, t, ahead, th_ahead, last = step / 2, 1.0, w.copy(), th.copy(), np.inf
            continue
        last = loss
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, th_ahead = new + (t - 1) / t2 * (new - w), np.sort(new_th + (t - 1) / t2 * (new_th - th))
        w, th, t = new, new_th, t2
    used = np.flatnonzero(w)
    return Model({int(kept[i]): float(w[i]) for i in used}, tuple(float(x) for x in th))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, toxic, features): ``per_class`` labelled rows of either class, those of least hash.

    ``features`` holds the hashed features in ascending order as bytes of 32-bit integers. Of rows with one id the least
    text counts, and of their labels the worst.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted({f for w in words_of(t) for f in word_features(w)}), np.int32).tobytes() for t in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(chosen, "doc_id").select("doc_id", "toxic", "text")
    found = map_batches(rows, run, "doc_id long, toxic int, features binary")
    return found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("features").alias("features"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, n_grades: int = GRADES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model for ``docs`` and their labels. Without both classes the model finds nothing toxic.

    The sample comes to the driver in the order of its rows' hashes, row by row, until it has ``sample_bytes``.
    """
    found = written(sample(docs, labels, per_class), "sample").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows, size = [], 0
    for row in found.coalesce(1).toLocalIterator():
        size += len(row["features"])
        if size > sample_bytes:
            break
        rows.append((row["doc_id"], row["toxic"], np.frombuffer(row["features"], np.int32)))
    rows.sort(key=lambda r: r[0])
    toxic = np.array([r[1] for r in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return Model({}, ())
    features = [r[2] for r in rows]
    return fit(features, grades(features, toxic, n_grades))


def _scores(model: Model, texts: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """w x for each text; ``cache`` remembers the features of words that the model has weights for."""
    scores = np.zeros(len(texts))
    for n, text in enumerate(texts):
        hit: set[int] = set()
        for word in words_of(text):
            found = cache.get(word)
            if found is None:
                if len(cache) >= CACHE:
                    cache.clear()
                found = cache[word] = tuple(f for f in word_features(word) if f in model.weights)
            hit.update(found)
        scores[n] = sum(model.weights[f] for f in sorted(hit))
    return scores


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns as they are. Null and empty texts are clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield batch.filter(pa.array(model.severity(_scores(model, strings(batch, text_col), cache))[0] < REJECT, pa.bool_()))

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with p_toxic, severity (expected grade), grade and rejected. A null or empty text has no features.

    Rows with equal ids are scored each by itself. Columns of these names give way to the results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = _scores(model, strings(batch, text_col), cache)
            p, severity, grade = model.severity(scores)
            columns = [pa.array(p), pa.array(severity), pa.array(grade, pa.int32()), pa.array(p >= REJECT)]
            names = ["p_toxic", "severity", "grade", "rejected"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    clash = [c for c in ("p_toxic", "severity", "grade", "rejected") if c in docs.columns]
    docs = docs.drop(*clash)  # results take the place of columns of the same names
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{fields}, p_toxic double, severity double, grade int, rejected boolean")

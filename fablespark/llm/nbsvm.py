"""Naive Bayes support vectors over n-gram indicators.

Wang and Manning (2012): each indicator is scaled by the log ratio of its
smoothed shares in the two classes, then a linear model is fitted to the
scaled vectors. The model is a hinge-loss one, fitted by dual coordinate
descent (Hsieh et al. 2008). A sigmoid (Platt) on rows kept from the fit turns
margins into scores from 0 to 1.

Training takes a bounded sample of labelled rows; its bound is a parameter.
Scoring runs over every whole text, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import columns_but, held_out, quoted
from fablespark.llm.ngram_features import indicators, runs


@dataclass(frozen=True)
class NbSvmSettings:
    """``max_rows`` bounds the labelled sample that a model is fitted on.

    ``min_z`` leaves out indicators whose share hardly differs between the classes:
    those whose log ratio is less than so many standard errors. ``balanced`` fits
    the sigmoid as if both classes were equally frequent.
    """

    max_rows: int = 5000
    min_df: int = 4
    min_z: float = 0.0
    smoothing: float = 1.0
    cost: float = 1.0
    rounds: int = 30
    tolerance: float = 1e-3
    calibration_share: float = 0.25
    balanced: bool = False
    seed: int = 7


@dataclass
class NbSvmModel:
    """Weights by feature code (sorted), intercept and sigmoid of a fitted model."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self._bits = 20
        self._seen: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": None}

    def _hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``code`` that are features, and which."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift = np.uint64(64 - self._bits)
        if self._seen is None:
            self._seen = np.zeros(1 << self._bits, bool)
            self._seen[self.codes >> shift] = True
        at = np.flatnonzero(self._seen[code >> shift])
        where = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        true = self.codes[where] == code[at]
        return at[true], where[true]

    def margins(self, extractor, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for start, run in runs(texts):
            keys = []
            for doc, code in extractor.codes(run):
                at, which = self._hits(code)
                keys.append(np.unique(doc[at].astype(np.int64) * len(self.codes) + which))
            if keys and (found := np.unique(np.concatenate(keys))).size:
                doc, which = np.divmod(found, len(self.codes))
                out[start : start + len(run)] += np.bincount(doc, self.weights[which], minlength=len(run))
        return out

    def scores(self, extractor, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(extractor, texts) + self.offset, -500, 500)))


def hinge_descent(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, costs: np.ndarray, rounds: int, tolerance: float, seed: int) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss; rows are CSR, y is -1 or 1."""
    w, alpha = np.zeros(n_features), np.zeros(len(y))
    square = np.array([np.dot(values[a:b], values[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            a, b = starts[i], starts[i + 1]
            col, val = columns[a:b], values[a:b]
            g = y[i] * np.dot(w[col], val) - 1
            step = min(max(alpha[i] - g / square[i], 0.0), costs[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[col] += step * y[i] * val
            pg = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= costs[i] else g
            worst = max(worst, abs(pg))
        if worst < tolerance:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, balanced: bool = False) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps; y is 0 or 1, targets are smoothed."""
    pos, neg = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, len(y) / (2 * max(pos, 1)), len(y) / (2 * max(neg, 1))) if balanced else np.ones(len(y))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(np.abs(margin).max(initial=0), 1e-9)
    x = np.column_stack([margin / scale, np.ones(len(y))])
    beta = np.array([0.0, 0.0 if balanced else np.log((pos + 1) / (neg + 1))])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(weight * (np.logaddexp(0, z) - t * z)) + 1e-6 * b[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (weight * (p - t)) + [2e-6 * beta[0], 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2e-6, 1e-9])
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(beta)
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(beta[0] / scale), 0.0), float(beta[1])


def fit(extractor, texts: list[str | None], labels: np.ndarray, s: NbSvmSettings) -> NbSvmModel:
    """Fit on texts and their 0/1 labels. One class or no text: a constant score."""
    y = np.asarray(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else (y.sum() + 0.5) / (len(y) + 1)
        return NbSvmModel(offset=float(np.log(share / (1 - share))))
    # Counts by class over the sample, gathered run by run.
    code, with_pos, with_neg = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal code, with_pos, with_neg
        allc = np.concatenate([code, *(p[0] for p in pending)])
        code, back = np.unique(allc, return_inverse=True)
        p = np.concatenate([with_pos, *(x[1] for x in pending)])
        n = np.concatenate([with_neg, *(1 - x[1] for x in pending)])
        with_pos = np.bincount(back, p, minlength=len(code)).astype(np.int32)
        with_neg = np.bincount(back, n, minlength=len(code)).astype(np.int32)
        pending.clear()

    for start, run in runs(texts):
        doc, c = indicators(extractor, run)
        pending.append((c, y[start + doc].astype(np.int32)))
        if sum(len(p[0]) for p in pending) > 3_000_000:
            merge()
    merge()
    p, q = with_pos + s.smoothing, with_neg + s.smoothing
    n_pos, n_neg = y.sum() + 2 * s.smoothing, len(y) - y.sum() + 2 * s.smoothing
    # A log ratio of two shares has the variance 1/p - 1/n_pos + 1/q - 1/n_neg.
    z = np.abs(np.log(p / n_pos) - np.log(q / n_neg)) / np.sqrt(1 / p - 1 / n_pos + 1 / q - 1 / n_neg)
    keep = (with_pos + with_neg >= min(s.min_df, max(1, len(y) // 10))) & (z >= s.min_z)
    code, p, q = code[keep], p[keep], q[keep]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # Rows of the scaled indicators, one more column for the intercept.
    bias = len(code)
    counts, columns = np.zeros(len(y), np.int64), []
    for start, run in runs(texts):
        doc, c = indicators(extractor, run)
        at = np.minimum(np.searchsorted(code, c), max(len(code) - 1, 0))
        hit = code[at] == c if len(code) else np.zeros(len(c), bool)
        doc, at = np.append(doc[hit], np.arange(len(run))), np.append(at[hit], np.full(len(run), bias))
        order = np.argsort(doc, kind="stable")
        columns.append(at[order].astype(np.int32))
        counts[start : start + len(run)] += np.bincount(doc, minlength=len(run))
    cols, starts = np.concatenate(columns), np.concatenate([[0], np.cumsum(counts)])
    scale = np.append(ratio, 1.0)
    values = scale[cols]
    rng = np.random.default_rng(s.seed)
    apart = rng.random(len(y)) < s.calibration_share
    if min(len(set(y[apart])), len(set(y[~apart]))) < 2:
        apart[:] = False
    sign = 2.0 * y - 1

    def solve(rows: np.ndarray) -> np.ndarray:
        idx = np.flatnonzero(rows)
        part = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in idx])
        sub = np.concatenate([[0], np.cumsum(counts[idx])])
        share = sign[idx] > 0
        cost = np.where(share, s.cost * np.sqrt(max((~share).sum() / share.sum(), 1e-9)), s.cost * np.sqrt(max(share.sum() / (~share).sum(), 1e-9)))
        norm = np.mean(values[part] ** 2) * np.mean(counts[idx])
        return hinge_descent(sub, cols[part], values[part], sign[idx], bias + 1, cost / norm * 10, s.rounds, s.tolerance, s.seed)

    w = solve(~apart)
    rows = np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    margin = np.array([np.dot(w[cols[starts[i] : starts[i + 1]]], values[starts[i] : starts[i + 1]]) for i in rows])
    slope, offset = sigmoid_fit(margin, y[rows], s.balanced)
    weight = w[:-1] * ratio
    strong = np.abs(weight) > 1e-9
    return NbSvmModel(code[strong], weight[strong], float(w[-1]), slope, offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled ids that are not held out.

    Ids are taken in order of a hash, so the choice is the same on every run.
    Ids with a null label, or with labels that contradict, take no part. Where
    rows of ``docs`` repeat an id, its least text counts, so that the sample is
    bounded whatever repeats.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"), F.max("_y").alias("_top"))
        .filter(F.col("_y") == F.col("_top"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
        .select("_id", "_y")
    )
    # max_rows pairs of numbers at most: safe to broadcast at any input size.
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str, extractor, settings: NbSvmSettings) -> NbSvmModel:
    """Fit in one task over the bounded sample; only the model comes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        data = pd.concat(got).sort_values("_id") if got else pd.DataFrame({"text": [], "_y": []})
        model = fit(extractor, list(data["text"]), data["_y"].to_numpy(dtype=np.int64), settings)
        yield pd.DataFrame({"codes": [model.codes.tobytes()], "weights": [model.weights.tobytes()], "intercept": [model.intercept], "slope": [model.slope], "offset": [model.offset]})

    sample = labelled_sample(docs, labels, label, settings.max_rows)
    rows = sample.repartition(1).mapInPandas(run, "codes binary, weights binary, intercept double, slope double, offset double").collect()
    if not rows:
        return NbSvmModel()
    r = rows[0]  # one task, one model
    return NbSvmModel(np.frombuffer(r["codes"], np.uint64), np.frombuffer(r["weights"], np.float64), r["intercept"], r["slope"], r["offset"])


def _over_texts(docs: DataFrame, names: list[str], schema: str, work) -> DataFrame:
    """Arrow batches of the named columns and the texts through ``work``; other columns are never converted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield work(b.select(range(b.num_columns - 1)), b.column(b.num_columns - 1).to_pylist())

    # By position, as mapInArrow can't take names with dots; the schema gives the names back.
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted(names))], F.col("text").alias("t")).mapInArrow(run, schema)


def _schema(docs: DataFrame, names: list[str]) -> list[str]:
    kinds = dict(docs.dtypes)
    return [f"`{c}` {kinds[c]}" for c in names]


def score(docs: DataFrame, extractor, model: NbSvmModel, threshold: float, columns: list[str] | None = None) -> DataFrame:
    """The columns (all, if none are named) with score and predicted; one pass, no shuffle.

    A null text scores as an empty one.
    """
    names = columns if columns is not None else columns_but(docs, "score", "predicted")

    def work(rest: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        got = model.scores(extractor, texts)
        return pa.RecordBatch.from_arrays([*rest.columns, pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return _over_texts(docs, names, ", ".join([*_schema(docs, names), "score double", "predicted int"]), work)


def keep(docs: DataFrame, extractor, model: NbSvmModel, threshold: float, predicted: int) -> DataFrame:
    """The rows of ``docs`` with that prediction, and no more columns; one pass, no shuffle."""
    names = docs.columns

    def work(rest: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        kept = rest.filter(pa.array((model.scores(extractor, texts) >= threshold) == bool(predicted)))
        return pa.RecordBatch.from_arrays(kept.columns, names=names)

    return _over_texts(docs, names, ", ".join(_schema(docs, names)), work)

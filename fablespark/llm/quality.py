"""Quality classifier: naive Bayes support vectors over token n-gram indicators.

Cases: a null text scores as an empty one; empty texts get the score of the
intercept; very long texts are read whole, in runs of bounded memory; repeated
rows score alike; an empty table gives an empty result; no usable label gives a
constant score. Columns named ``score`` or ``predicted`` in the input are
replaced by the results; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fablespark.llm.nbsvm import NbSvmModel, NbSvmSettings, keep, score, train
from fablespark.llm.ngram_features import TokenShapes

#: Documents that score less are rejected.
THRESHOLD = 0.3
SETTINGS = NbSvmSettings(max_rows=5000)
FEATURES = TokenShapes(max_order=3, words=True)


def train_quality(docs: DataFrame, labels: DataFrame, settings: NbSvmSettings = SETTINGS) -> NbSvmModel:
    """Fit on ``labels.quality`` of rows outside the held-out fold."""
    return train(docs, labels, "quality", FEATURES, settings)


def score_quality(docs: DataFrame, model: NbSvmModel, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1: keep)."""
    return score(docs, FEATURES, model, threshold, columns)


def keep_good(docs: DataFrame, model: NbSvmModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    return keep(docs, FEATURES, model, threshold, 1)

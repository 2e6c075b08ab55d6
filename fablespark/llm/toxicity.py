"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Cases: a null text scores as an empty one; empty texts get the score of the
intercept; very long texts are read whole, in runs of bounded memory; repeated
rows score alike; an empty table gives an empty result; no usable label gives a
constant score. Columns named ``score`` or ``predicted`` in the input are
replaced by the results; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fablespark.llm.nbsvm import NbSvmModel, NbSvmSettings, keep, score, train
from fablespark.llm.ngram_features import CharNgrams

#: Documents that score this or more are toxic.
THRESHOLD = 0.5
SETTINGS = NbSvmSettings(max_rows=5000, min_df=3, min_z=2.5, cost=0.1, balanced=True)
#: Long n-grams tell word beginnings that are insults from the same letters within words.
FEATURES = CharNgrams((4, 6, 8))


def train_toxicity(docs: DataFrame, labels: DataFrame, settings: NbSvmSettings = SETTINGS) -> NbSvmModel:
    """Fit on ``labels.toxic`` of rows outside the held-out fold."""
    return train(docs, labels, "toxic", FEATURES, settings)


def score_toxicity(docs: DataFrame, model: NbSvmModel, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1, higher: more toxic) and predicted (1: toxic)."""
    return score(docs, FEATURES, model, threshold, columns)


def keep_clean(docs: DataFrame, model: NbSvmModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    return keep(docs, FEATURES, model, threshold, 0)

"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(theta_j - w . x) with one weight per hashed term (words,
their shapes, and shares of repeated, capital and sign-ridden words) shared by all
grades and ordered thresholds theta_1 < theta_2 < ... From these come the
expected grade and, for any grade, the probability of reaching it, by which
documents are selected. Fitted by the driver on a bounded sample of rated
documents, applied to every text where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm import terms as t


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class OrdinalModel:
    active: np.ndarray
    w: np.ndarray
    theta: np.ndarray

    def tails(self, at: np.ndarray) -> list[float]:
        """Expected grade, then P(grade >= 1), P(grade >= 2), ..."""
        tail = _logistic(self.w[at].sum() - self.theta)
        return [float(tail.sum()), *tail.tolist()]


def _ordered(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12_000,
        most_terms: int = 512, least_chi2: float = 25.0, epochs: int = 25, steps: int = 400, penalty: float = 1e-4, seed: int = 13) -> OrdinalModel:
    """Fit on at most `sample_rows` rated documents; `ratings` is (id, grade) with grades 0 to `grades` - 1.

    The sample is gone through `epochs` times, a small one until `steps` batches were seen.

    The thresholds start from the shares of the grades; with no ratings, or one
    grade only, they stay there.
    """
    found = t.examples(t.sample(docs, ratings, id_col, text_col, sample_rows), t.shape_terms, t.share_terms, most_terms, least_chi2)
    rng = np.random.default_rng(seed)
    counts = np.bincount(found.ratings, minlength=grades)[:grades] + 0.5
    below = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(below / (1 - below))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(len(found.active))
    if len(found.active):
        step = t.adam([raw, w])
        for _ in range(found.passes(epochs, steps, 512)):
            for x, y in found.batches(512, rng):
                theta, z = _ordered(raw), x @ w
                # cumulative probabilities at both ends of each example's grade
                ends = np.concatenate([np.full((len(y), 1), 0.0), _logistic(theta[None, :] - z[:, None]), np.full((len(y), 1), 1.0)], axis=1)
                rows = np.arange(len(y))
                low, high = ends[rows, y], ends[rows, y + 1]
                mass = np.maximum(high - low, 1e-12)
                slope_low, slope_high = low * (1 - low), high * (1 - high)
                g_theta = np.zeros((len(y), grades + 1))
                g_theta[rows, y + 1] -= slope_high / mass
                g_theta[rows, y] += slope_low / mass
                g = g_theta[:, 1:-1].mean(0)
                g_raw = np.concatenate([[g.sum()], [np.exp(raw[j]) * g[j:].sum() for j in range(1, len(raw))]])
                gz = (slope_high - slope_low) / mass / len(y)
                step([g_raw, x.T @ gz + penalty * w])
    return OrdinalModel(found.active, w, _ordered(raw))


def quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", grade_col: str = "expected_grade", tail_prefix: str = "p_grade_",
            keep_text: bool = False) -> DataFrame:
    """`docs` with the expected grade and `p_grade_1`, `p_grade_2`, ... for every row; without the text unless `keep_text`.

    Null and empty texts get the values of a text without terms. Other columns
    are passed on, but for those called like a column that is added, which are
    replaced; repeated rows come out alike; an empty table gives an empty table.
    """
    names = [grade_col, *(f"{tail_prefix}{j}" for j in range(1, len(model.theta) + 1))]
    return t.score_texts(docs, text_col, model.active, t.shape_terms, t.share_terms, model.tails, names, keep_text)

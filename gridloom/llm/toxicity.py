"""Toxicity by a factorization machine over hashed terms.

The score of a text is the logistic of w0 + sum of w[i] + sum over pairs of
<v[i], v[j]> over its distinct active terms (words and their beginnings): the
pairs add what a word means next to another, which linear weights cannot. The
machine is fitted by the driver on a bounded sample of labelled documents and
applied to every text where it lies; scoring shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm import terms as t


@dataclass
class FactorizationMachine:
    active: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray) -> float:
        vs = self.v[at]
        pairs = 0.5 * float((vs.sum(0) ** 2 - (vs ** 2).sum(0)).sum())
        z = self.w0 + float(self.w[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12_000, most_terms: int = 4096,
        least_chi2: float = 25.0, pair_terms: int = 512, factors: int = 8, epochs: int = 25, steps: int = 400, penalty: float = 1e-4, seed: int = 11) -> FactorizationMachine:
    """Fit on at most `sample_rows` labelled documents; `labels` is (id, 0 or 1).

    Terms are kept that correlate with the label, alone or in a pair; pairs are
    looked for among the `pair_terms` best and as many most evenly spread terms.
    The sample is gone through `epochs` times, a small one until `steps` batches were seen.

    Without labels, or with one label only, the score is that label's share.
    """
    found = t.examples(t.sample(docs, labels, id_col, text_col, sample_rows), t.word_terms, t.no_terms, most_terms, least_chi2, pair_terms)
    rng = np.random.default_rng(seed)
    share = (found.ratings.sum() + 0.5) / (len(found.ratings) + 1)
    w0, w = np.array([np.log(share / (1 - share))]), np.zeros(len(found.active))
    v = rng.normal(0, 0.01, (len(found.active), factors))
    if len(found.active):
        step = t.adam([w0, w, v])
        for _ in range(found.passes(epochs, steps, 512)):
            for x, y in found.batches(512, rng):
                xv = x @ v
                z = w0 + x @ w + 0.5 * (xv ** 2 - x @ v ** 2).sum(1)
                e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
                gw = x.T @ e
                step([np.array([e.sum()]), gw + penalty * w, x.T @ (e[:, None] * xv) - v * gw[:, None] + penalty * v])
    return FactorizationMachine(found.active, float(w0[0]), w, v)


def toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` without the text and with a score from 0 to 1 for every row.

    Null and empty texts get the score of a text without terms. Other columns
    are passed on; repeated rows come out alike; an empty table gives an empty
    table.
    """
    return t.score_texts(docs, text_col, model.active, t.word_terms, t.no_terms, lambda at: [model.score(at)], [score_col])

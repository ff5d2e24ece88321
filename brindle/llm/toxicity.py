"""Toxicity scores learnt from confirmed toxic examples and unlabelled text.

Nulls: a null text is scored as the empty text; a null id has a null fold and is never learnt
from. Empty tables give an empty result; without toxic examples every score is the class prior.
Repeated rows are scored alike, one result row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import positive_unlabelled as pu

SPEC = pu.FeatureSpec(bits=20, prefixes=(5, 7), shapes=False, min_support=3, min_ratio=4.0, evidence_only=True, rates=(300, 100, 30), min_z=3.0, letters=True)


def train(docs: DataFrame, labels: DataFrame, *, spec: pu.FeatureSpec = SPEC, **options) -> pu.Model:
    return pu.train(docs, labels, "toxic", spec, **{"steps": 300, "l2": 1e-3, "batch": 4096, "rate": 0.1} | options)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, **options)
    scored = pu.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (pu.fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

"""Quality scores by positive-unlabelled learning: trusted positives against unlabelled web text.

Nulls: a null text is scored as the empty text; a null id has a null fold and is never learnt
from. Empty tables give an empty result; without trusted positives every score is the prior.
Repeated rows are scored alike, one result row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import positive_unlabelled as pu

SPEC = pu.FeatureSpec(bits=4, word_features=False, shapes=True)
OPTIONS = {"steps": 600, "l2": 1e-5, "batch": 1024}


def train(docs: DataFrame, labels: DataFrame, *, spec: pu.FeatureSpec = SPEC, **options) -> pu.Model:
    return pu.train(docs, labels, "quality", spec, **OPTIONS | options)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, **options)
    scored = pu.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (pu.fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns."""
    model = train(docs, labels, **options)
    name = "score"
    while name in docs.columns:
        name += "_"
    return pu.score(docs, model, out_col=name).where(F.col(name) >= threshold).select(*docs.columns)

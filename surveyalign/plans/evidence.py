"""Prototypes, retrieval and prediction for the test trips of the second survey."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from surveyalign.functions import fixed_values as fv
from surveyalign.operators import metrics
from surveyalign.operators.filters import filter_valid_predictions
from surveyalign.operators.inference import Predictor, batch_inference, build_prompts, majority_predictor, retrieve_evidence
from surveyalign.operators.joins import attach_predictions
from surveyalign.operators.prototypes import PrototypeMemory, build_prototypes
from surveyalign.operators.retrieval import build_index, build_memory
from surveyalign.operators.sampling import dry_run_sample, split_test_pool_fewshot
from surveyalign.session import materialize


@dataclass
class EvidenceRun:
    predictions: DataFrame
    metrics: DataFrame


def run_evidence(
    historical: DataFrame,
    current: DataFrame,
    fewshot_ratio: float = 0.01,
    seed: int = 42,
    predictor: Predictor = majority_predictor,
    prototypes: PrototypeMemory | None = None,
    n_samples: int | None = None,
    top_k: int = fv.TOP_K,
) -> EvidenceRun:
    """Split the current survey, retrieve evidence for its test trips, predict and score them.

    Both inputs should be stored tables. ``n_samples`` limits a trial run.
    """
    prototypes = prototypes or build_prototypes(historical, seed=seed)
    encoder = prototypes.encoder
    split = materialize(split_test_pool_fewshot(current, fewshot_ratio=fewshot_ratio, seed=seed), "split")
    test = split.where("split = 'test'").drop("split")
    if n_samples:
        test = dry_run_sample(test, n_samples, seed)
    past, _ = build_memory(historical, encoder)
    recent, _ = build_memory(split.where("split = 'few_shot'").drop("split"), encoder)
    evidence = retrieve_evidence(
        encoder.transform(test), build_index(past, top_k // 2), build_index(recent, top_k), prototypes, top_k)
    answers = materialize(batch_inference(build_prompts(evidence), predictor), "answers")
    predictions = attach_predictions(test, answers)
    cube = materialize(metrics.confusion_cube(filter_valid_predictions(predictions)), "cube")
    return EvidenceRun(predictions, metrics.evaluate_micro(cube).unionByName(metrics.evaluate_macro(cube)))

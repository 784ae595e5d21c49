"""Analysis of a result table: all reports as independent lazy plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from textpair.operators import averages, compare, distributions
from textpair.operators.similarity import Embedder, semantic_similarity
from textpair.sources.results import write_case_slices


def analyze_results(
    results: DataFrame,
    compare_models: Sequence[int] = (0, 1),
    order: str = "model_ord",
    compute_similarity: bool = False,
    embedder: Embedder | None = None,
    save_path: str | None = None,
    save: Sequence[str] = (),
    counted: bool = False,
) -> dict[str, DataFrame]:
    """Every report of a comparison, keyed by name.

    ``results`` should be a stored table: each report then reads only its own
    columns, which is cheaper than caching the texts.  ``order`` is the column by
    which models are ordered; ``evaluate_models`` and ``read_results`` give
    ``model_ord``.  ``save`` names slices
    to write below ``save_path``: ``zeros``, ``outperformed``, ``best``,
    ``worst``.  With ``counted`` equal pairs of ``outperformed`` are one row and
    ``n`` is their number, so copies of a target do not multiply.
    """
    models = averages.models_in_order(results, order)
    first, second = averages.select_model_pair(models, compare_models)
    pair = [first, second]
    by_size = averages.avg_scores_by_size(results, first)
    reports = {
        "models": models,
        "histogram": distributions.score_histogram(results, pair),
        "histogram_overlay": distributions.histogram_overlay(results, pair),
        "density": distributions.score_density(results, pair),
        "averages": averages.avg_scores_by_model(results),
        "gap": averages.model_gap(results, first, second),
        "outperformed": compare.outperformed_rows(results, second, first, counted=counted),
        "zeros": compare.zero_score_rows(results, first),
        "best": compare.best_rows(results, first),
        "worst": compare.worst_rows(results, first),
        "lengths": averages.output_length_range(results, first),
        "by_size": by_size,
        "by_size_diff": averages.size_score_diff(by_size),
    }
    if compute_similarity:
        similar = semantic_similarity(results, first, embedder)
        pairs, correlation = distributions.similarity_vs_rouge(similar, first)
        reports |= {
            "similarity": similar,
            "similarity_vs_rouge": pairs,
            "similarity_correlation": correlation,
            "similarity_histogram": distributions.similarity_histogram(similar, first),
        }
    if save:
        if save_path is None:
            raise ValueError("save_path is needed to save slices")
        names = {"outperformed": f"better_{second}"}
        write_case_slices({names.get(s, s): reports[s] for s in save}, save_path)
    return reports

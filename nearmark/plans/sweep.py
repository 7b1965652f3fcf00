"""Evaluation over a grid of parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchParams
from ..operators import evaluate, knn
from .score import score


def sweep(inputs: Callable[[int], tuple[DataFrame, DataFrame]], profiles: Iterable[int], partitions: Iterable[int], own: str | None = None) -> DataFrame:
    """profile, max_partitions, and the figures, average searched partitions and scanned references of each pair.

    inputs(profile) gives queries (with expected_approved) and references keyed by that partition profile."""
    out = []
    for profile in profiles:
        queries, refs = inputs(profile)
        for most in partitions:
            found = knn.keep(score(queries, refs, SearchParams(kd=True, max_partitions=most), own))
            scored = found.join(queries.select("id", "expected_approved"), "id")
            searched = found.agg(F.avg("searched").alias("avg_searched"), F.avg("scanned").alias("avg_scanned"))
            out.append(evaluate.report(scored).crossJoin(searched).withColumns({"profile": F.lit(profile), "max_partitions": F.lit(most)}))
    return reduce(DataFrame.unionByName, out)

"""Two engines: one answers, the other is run beside it for a sample of queries and compared.

Queries are sampled by a hash of their text, so a query is compared always or never and reruns agree. What a
comparison finds is counted while it is written; if the second engine or the comparison
fails, the answer stands and the failure is told.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cotejo.operators.compare import compare, largest_differences
from cotejo.session import cut

Engine = Callable[[DataFrame], DataFrame]
#: Queries are sampled by the first 32 bits of their digest.
SPACE = 1 << 32


@dataclass
class Answer:
    """The first engine's rows; a row a sampled query, or None; how many there were and differed; what went wrong."""

    result: DataFrame
    comparison: DataFrame | None = None
    differences: DataFrame | None = None
    metrics: dict = field(default_factory=dict)
    error: Exception | None = None


def sampled(query: Column, rate: float) -> Column:
    """Whether a query is among a share of all texts."""
    place = F.conv(F.substring(F.md5(F.encode(query, "UTF-8")), 1, 8), 16, 10).cast("long")
    return F.coalesce(place < int(min(1.0, max(0.0, rate)) * SPACE), F.lit(False))


def shadow(queries: DataFrame, first: Engine, second: Engine, rate: float, on_difference: Callable[[DataFrame], None] | None = None) -> Answer:
    """Answers (query_id, query) with ``first``; both engines give (query_id, doc_id, rank, score).

    The second engine is given the sampled queries only. ``on_difference`` gets the comparison's rows
    that are not within the bounds, if there are any. A query without a result in either engine has no
    row in the comparison.
    """
    result = cut(first(queries).select("query_id", "doc_id", "rank", "score"))
    answer = Answer(result)
    try:
        asked = cut(queries.where(sampled(F.col("query"), rate)).select("query_id", "query"))
        other = cut(second(asked).select("query_id", "doc_id", "rank", "score"))
        mine = result.join(asked.select("query_id"), "query_id", "left_semi")
        seen = Observation(f"shadow-{uuid.uuid4().hex[:8]}")
        counts = [F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("agrees")).alias("differing"), F.avg("jaccard").alias("mean_jaccard"), F.max("score_error").alias("most_score_error")]
        answer.comparison = cut(compare(mine, other).observe(seen, *counts))
        answer.metrics = dict(seen.get)
        answer.differences = largest_differences(mine, other)
        if on_difference is not None and answer.metrics["differing"]:
            on_difference(answer.comparison.where(~F.col("agrees")))
    except Exception as failed:  # whatever an engine raises must not cost the answer
        answer.error = failed
        warnings.warn(f"comparing engines failed: {failed}", stacklevel=2)
    return answer

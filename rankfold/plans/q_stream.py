"""Step 10 queries: streaming forms, run on a file source with the
available-now trigger; each must equal its batch form."""

from __future__ import annotations

from rankfold.plans.q_ingest import STRENGTH_SQL
from rankfold.plans.q_stats import q_interaction_stats  # noqa: F401  (shares the oracle)
from rankfold.plans.registry import QUERIES, query
from rankfold.streaming import streams


@query("running_stats", sql=QUERIES["interaction_stats"].sql)
def q_running_stats(spark, sf):
    return streams.running_stats(spark, sf)


@query("stream_strength", sql=STRENGTH_SQL)
def q_stream_strength(spark, sf):
    return streams.stream_strength(spark, sf)

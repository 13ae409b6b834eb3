"""All registered queries."""

from voxlake.plans import (  # noqa: F401
    corpus_queries,
    flagship,
    pipeline_queries,
    score_queries,
    service_queries,
    stream_queries,
    text_queries,
    word_queries,
)
from voxlake.plans.registry import ORACLES, QUERIES  # noqa: F401

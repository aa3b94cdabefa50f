"""All queries of this folder and their SQL twins."""

import corpus_pipeline
from paceline.llm import (  # noqa: F401  (register queries)
    codes,
    ctw,
    decontaminate,
    lines,
    neardup,
    pieces,
    pseudonyms,
    quality,
    resampling,
    secrets,
    sharding,
    toolcalls,
    topk,
)
from paceline.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["ORACLES", "QUERIES"]

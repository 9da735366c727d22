"""Query catalogue: importing this package registers every named query."""

from . import decontam_q, fewshot_q, files_q, filters_q, metrics_q, misc_q, mkqa_q, nested_q, requests_q, runs_q, stats_q, stream_q, text_q  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""sparkeval — evaluation-data operators (decontamination, answer extraction, scoring,
metrics, sampling, retrieval, run roll-ups) as Spark DataFrame / SQL / Streaming jobs."""

__version__ = "0.1.0"

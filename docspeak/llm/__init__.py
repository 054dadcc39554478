"""Operators of a training-data pipeline, one module each; see ``docspeak/llm/queries.py``."""

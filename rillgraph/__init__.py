"""Rillgraph: per-key window features and temporal patterns over edge streams, on Spark."""

__version__ = "0.1.0"

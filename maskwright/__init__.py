"""Reversible, per-scope text de-identification on Spark."""

__version__ = "0.1.0"

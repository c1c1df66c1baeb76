"""Post-training data analytics on Spark: grading, selection, audits, accounting and batch planning as DataFrame operators."""

__version__ = "0.1.0"

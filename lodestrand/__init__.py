"""Batch retrieval, evaluation and conversation-log jobs as plain PySpark functions."""

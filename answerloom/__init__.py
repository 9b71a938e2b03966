"""Spark-native analytics for question-answering data: ingestion, splits, scoring, rewards, verdicts and reports."""

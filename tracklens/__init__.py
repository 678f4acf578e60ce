"""Spark-native audit, merge and scoring of timestamped transcripts."""

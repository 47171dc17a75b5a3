"""Corpus analytics on Spark: composable DataFrame operators for building and measuring text corpora."""

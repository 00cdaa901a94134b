"""Operators for preparing language-model training corpora on Spark."""

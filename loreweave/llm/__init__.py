"""Operators for building and cleaning training corpora on Spark."""

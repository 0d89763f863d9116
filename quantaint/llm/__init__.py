"""Operators for building language-model training data from a document corpus."""

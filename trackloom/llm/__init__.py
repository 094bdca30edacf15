"""Operators for large training corpora, each one a Spark job of its own; nothing else in the package uses them."""

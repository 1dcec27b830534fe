"""Sequence analytics with hidden Markov models on PySpark."""

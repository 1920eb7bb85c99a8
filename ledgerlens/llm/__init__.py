"""Operators of a training-data pipeline: text, vectors and web pages.  Nothing outside this folder imports it."""

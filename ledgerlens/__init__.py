"""Spark jobs and query operators for token-ledger analytics.

Every operator is a function from DataFrames to a DataFrame.  Nothing here creates a session or reads the
clock: the caller passes the session's data and an explicit ``as_of`` where a time matters.
"""

"""Operators: DataFrame in, DataFrame out, lazy unless stated."""

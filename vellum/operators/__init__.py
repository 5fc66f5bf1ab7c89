"""Measures, votes, rankings and graph operations over DataFrames."""

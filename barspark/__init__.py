"""Intraday bar analytics, corpus operators and their streams on Spark DataFrames."""

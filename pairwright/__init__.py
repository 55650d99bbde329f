"""Preference-data and answer-evaluation operators on Spark DataFrames."""

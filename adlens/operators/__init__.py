"""Relational operators of the ad-analytics engine (all return lazy DataFrames)."""

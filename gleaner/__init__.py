"""Mines templates from log text and finds the rare ones, on Spark DataFrames."""

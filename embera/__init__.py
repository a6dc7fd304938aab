"""Embera: embedding search, cache maintenance, clustering and evaluation on Spark DataFrames."""

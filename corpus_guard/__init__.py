"""Corpus-security and supply-chain analytics on Spark DataFrames."""

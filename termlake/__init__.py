"""Governed vocabularies, documents, claims and signals as Spark DataFrames."""

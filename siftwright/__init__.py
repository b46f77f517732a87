"""Siftwright: conversational and document text analytics on Spark DataFrames."""

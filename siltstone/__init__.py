"""Siltstone: byte payloads, compressed frames and text corpora as Spark DataFrames."""

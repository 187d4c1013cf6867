"""Readers: files of every supported format as DataFrames."""

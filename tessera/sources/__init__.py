"""Readers (files to DataFrames) and writers (DataFrames to files)."""

"""Scantling: few-shot scorer benchmarking and text data processing on Spark DataFrames."""

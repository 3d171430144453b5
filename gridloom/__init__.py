"""gridloom: time-series analytics for regularly sampled operational data on Spark.

Every operator takes and returns DataFrames; rows are addressed by the series
columns and a timestamp, never by their position in a file.
"""

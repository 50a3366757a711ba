"""Tideway: table replication, incremental sync and validation on Spark DataFrames."""

"""Spark jobs for historical graphs: sequences of labelled snapshots kept in DataFrames."""

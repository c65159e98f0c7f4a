"""Repository analytics on Spark.

Every operator is a plain function from DataFrames to a DataFrame, keyed by
``repo_id`` so one job covers many repositories and repositories of any size.
"""

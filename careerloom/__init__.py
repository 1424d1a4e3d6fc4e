"""careerloom: people-and-company panels from career-profile tables, on Spark.

Every operator takes and returns DataFrames and stays lazy; the IDs in the
"""

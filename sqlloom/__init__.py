"""sqlloom: SQL-corpus diagnosis, corpus building and evaluation as Spark DataFrames."""

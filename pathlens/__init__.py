"""Search and analytics over file-system catalogs, on Spark DataFrames."""

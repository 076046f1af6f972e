"""Secret, endpoint and parameter analytics over text, expressed as Spark DataFrames."""

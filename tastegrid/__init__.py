"""tastegrid: collaborative filtering on one-class feedback, as Spark DataFrames."""

"""tidegraph: many time series, their components and their graphs as Spark DataFrames."""

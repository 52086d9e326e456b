"""Resolution of event listings and the feed over them, as Spark DataFrames."""

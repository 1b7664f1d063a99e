"""kairolog: analytics over versioned, append-only tables, on Spark DataFrames."""

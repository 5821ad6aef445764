"""Basketball analytics on Spark: box scores, stints, features, models and reports as DataFrame jobs."""

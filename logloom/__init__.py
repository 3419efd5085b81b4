"""Log analytics on Spark: read, parse, search, measure, mine, alert, diagnose."""

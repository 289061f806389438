"""shelfcast: analysis and forecasting of daily retail sales as Spark jobs.

Every public function takes and returns a DataFrame (or a Column); the session
belongs to the caller.  See README.md for the rules on skew and size.
"""

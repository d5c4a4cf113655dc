"""Visual-analytics operators for Spark: lazy ``DataFrame -> DataFrame`` functions."""

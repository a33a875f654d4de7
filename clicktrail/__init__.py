"""Session analytics on clickstreams with PySpark DataFrames."""

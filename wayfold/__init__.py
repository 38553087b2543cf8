"""Analytics over posed, time-stamped 3D captures, on Spark DataFrames."""

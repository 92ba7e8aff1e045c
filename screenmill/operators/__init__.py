"""Jobs: they take and return DataFrames; none collects rows to the driver."""

"""Query and resolution operators: functions from DataFrames to DataFrames."""

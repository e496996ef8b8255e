"""Operators: functions from DataFrames to DataFrames, without session state and without collecting rows."""

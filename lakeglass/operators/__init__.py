"""Operators: functions of a DataFrame and a request."""

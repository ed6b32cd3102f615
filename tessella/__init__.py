"""Curation and evaluation analytics on PySpark: functions from DataFrame to DataFrame."""

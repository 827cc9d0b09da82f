"""gradewell: preference-data and reward analytics on Spark DataFrames."""

__version__ = "0.1.0"

"""tabulon: panel-data preparation and applied statistics as Spark jobs.

Everything is a function from DataFrames and Columns to DataFrames and Columns,
so whole pipelines stay lazy and Catalyst sees them end to end.
"""

__version__ = "0.1.0"

"""almanac: Spark-native analytics over archives of dated text bulletins.

Every operator takes and returns DataFrames (or Columns) and is expressed
with built-in Spark SQL expressions, windows, aggregates and joins.
"""

__version__ = "0.1.0"

"""memlode: a Spark-native engine for agent memories, their entity graph and the signals drawn from them.

Every operator is a function from DataFrames and explicit parameters (the clock included) to a DataFrame, so
Catalyst sees one declarative plan per query.
"""

__version__ = "0.1.0"

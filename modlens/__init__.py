"""Spark-native preparation and evaluation of text-moderation data.

Everything here is a function from DataFrame to DataFrame (or a column
expression).  There is no engine layer: Catalyst plans and Tungsten executes.
"""

__version__ = "0.1.0"

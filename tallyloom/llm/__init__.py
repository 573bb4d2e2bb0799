"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` applies them to the driver's tables.
"""

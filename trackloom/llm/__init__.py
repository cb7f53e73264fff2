"""Training-data operators: ten corpus operations built on Spark DataFrames.

Nothing else in the package imports this subpackage; `registry` lists its queries.
"""

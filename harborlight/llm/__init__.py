"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface (DataFrames in, DataFrames out); :mod:`harborlight.llm.queries` binds them to the tables.
"""

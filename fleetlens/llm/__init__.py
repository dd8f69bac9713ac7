"""Operators of a training-data pipeline over document and conversation tables.

Nothing else in the package imports this subpackage. Every operator takes
DataFrames, selects the columns it names (so further columns, also such with
clashing names, are left alone) and returns a lazy DataFrame, unless its
docstring says that it stages an intermediate table.
"""

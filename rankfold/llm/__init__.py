"""Training-data operators over document, page, conversation and vector tables.

Nothing else in the package imports this subpackage. Every operator takes
DataFrames, selects the columns it needs first (extra columns, whatever their
names, are ignored or passed through untouched) and returns a DataFrame.
"""

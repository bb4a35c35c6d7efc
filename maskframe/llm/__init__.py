"""Training-data operators: extraction, scanning, de-duplication, scoring, mixing and packing.

Nothing outside this package imports it. Every operator is a function from DataFrames to a DataFrame;
:mod:`maskframe.llm.queries` applies them to the tables named in the query contracts.
"""

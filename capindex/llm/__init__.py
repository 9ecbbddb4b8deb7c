"""Training-data operators on Spark tables (documents, pages, conversations, benchmark).

Ten operators, each in a module of its own with a general interface; ``queries`` registers one
whole-table query per operator and the DuckDB twins where SQL can express the result. Nothing outside
this package imports it.
"""

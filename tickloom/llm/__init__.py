"""Training-data operators; nothing outside this package and corpus_pipeline.py uses them.

Columns whose names begin with an underscore are the operators' own.  Other columns of an input may have any
name: operators pick the columns they need by name, and result columns replace input columns of their name.
"""

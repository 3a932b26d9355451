"""Training-corpus operators: extraction, cleaning, dedup, mixing, packing and tokenising.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame, names the columns it
reads, and either returns the rows it was given (filters) or a result keyed by the given id column.
"""

"""Training-data operators: packing, tokenizing, deduplication, classification and binary output.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames.
"""

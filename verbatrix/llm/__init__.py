"""Training-data operators: mixing, deduplication, tokenised output, packing, filters and search.

Nothing outside this folder imports it; it can be deleted without harm to the rest of the library.
"""

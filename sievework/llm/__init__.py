"""Training-data operators: token counts, filters, deduplication, mixing and packing.

Nothing outside this subpackage imports it.
"""

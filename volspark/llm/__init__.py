"""Training-data operators: search, token output, filters, dedup, packing, rendering and extraction.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""

"""Training-data operators: extraction, deduplication, tokens, packing, mixing, search.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when the package is present.
"""

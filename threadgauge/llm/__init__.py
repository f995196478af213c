"""Training-data operators: deduplication, tokens, packing, filters, extraction, archives and vector search.

Nothing else in the package imports this subpackage. ``queries`` registers one
thin query per operator and the corpus pipeline.
"""

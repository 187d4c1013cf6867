"""Training-data operators: filtering, deduplication, scoring, mixing and packing of documents.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""

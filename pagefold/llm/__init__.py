"""Training-data operators: tokenization, packing, search, near duplicates, quality, secrets, toxicity, licences.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""

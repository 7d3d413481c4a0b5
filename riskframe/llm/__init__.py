"""Training-data operators: dedup, language, fingerprints, mixing, quality, chat, secrets, tokens, toxicity.

One module per operator; ``queries.py`` binds each to its driver table. Nothing
outside this package imports it (``__spark_entry__`` adds it when present).
"""

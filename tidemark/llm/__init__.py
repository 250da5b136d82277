"""Training-data operators: toxicity, packing, near-duplicates, language ID, search, tokens, HTML and repeated passages."""

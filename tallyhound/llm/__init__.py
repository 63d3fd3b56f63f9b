"""Training-data operators: dedup, packing, quality, language, tokenisation, search."""

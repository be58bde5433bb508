"""Training-data operators: deduplication, language and quality models, extraction, mixing, packing."""

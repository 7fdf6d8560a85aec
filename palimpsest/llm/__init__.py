"""Training-data operators: quality, dedup, licenses, mixing, language, extraction, search and tokens."""

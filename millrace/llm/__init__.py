"""Training-data operators: search, deduplication, language, PII, tokenizing, mixing, quality, digests."""

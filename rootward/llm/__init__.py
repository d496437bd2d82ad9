"""Training-data operators: WARC, PII, sharding, de-duplication, quality, tokens."""

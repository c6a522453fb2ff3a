"""Training-data operators: dedup, quality, toxicity, language, packing, mixing, sharding, WARC."""

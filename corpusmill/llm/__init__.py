"""Training-data operators: sharding, near-dedup, search, PII, toxicity, repeats, URL filters, mixing, fingerprints, packing."""

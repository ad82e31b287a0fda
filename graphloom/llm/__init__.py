"""Training-data operators: language id, dedup, packing, mixing, scans, quality, archives, URL rules."""

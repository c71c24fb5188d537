"""Training-data operators: ranking, consensus, top-N, near duplicates, look-alike text, leaks, mixing, shared spans."""

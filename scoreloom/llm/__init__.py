"""Training-data operators: packing, sharding, mixing, filters, decontamination, fingerprints, near duplicates, secrets."""

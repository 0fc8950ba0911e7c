"""Training-data operators: archives, search, decontamination, dedup, mixing, sharding."""

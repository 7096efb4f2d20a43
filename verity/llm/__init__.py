"""Training-data operators: tokenising, privacy, decontamination, scoring, filters and sharding."""

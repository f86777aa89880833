"""Training-data operators: dedup, decontamination, language, quality, mixing, token output."""

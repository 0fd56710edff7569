"""Training-data operators: quality, language-model scoring, sharding, mixing, token files,
near duplicates, classification, secrets, decontamination and chat formatting."""

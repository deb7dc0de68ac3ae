"""Training-data operators: quality, toxicity, rules, mixing, decontamination,
sharding, extraction, substring and near-duplicate removal, chat formatting."""

"""Training-data operators: quality, dedup, sharding, archives, language, tokens, URLs, secrets, leaks."""

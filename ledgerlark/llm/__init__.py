"""Training-data operators: quality, toxicity, dedup, sharding, packing, tokenising, chats and web archives."""

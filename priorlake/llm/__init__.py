"""Training-data operators: counts, deduplication, secrets, quality, encoding, chats and mixing."""

"""Training-data operators: quality, identification, tokens, duplicates, packing, chat, scoring."""

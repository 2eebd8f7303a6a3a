"""Training-data operators: chat text, deduplication, archives, quality, tokens, pages and decontamination."""

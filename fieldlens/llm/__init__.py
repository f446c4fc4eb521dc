"""Training-data operators: language, duplicates, archives, pages, contamination, tokens, quality, mixing."""

"""Operations on training text: filters, deduplication, tokens, scores."""

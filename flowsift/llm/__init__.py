"""Operations of a training-data pipeline: deduplication, filtering, search, tokens."""

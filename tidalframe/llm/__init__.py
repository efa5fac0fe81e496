"""Operations of a training-data pipeline: deduplication, filters, models and mixing over text tables."""

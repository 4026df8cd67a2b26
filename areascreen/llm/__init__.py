"""Operations of a training-data pipeline: cleaning, matching, scoring, packing and sharding of texts."""

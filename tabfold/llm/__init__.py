"""Operations of a large training-data pipeline, each one module."""

"""Operations that a training-data pipeline needs beyond the timeline engine."""

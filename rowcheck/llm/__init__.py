"""Operations of a training-data pipeline; nothing else in rowcheck imports this subpackage."""

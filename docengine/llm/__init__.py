"""Operations for preparing training data at scale."""

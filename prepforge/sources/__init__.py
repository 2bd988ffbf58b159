"""Reading, typing and hashing files; append-only state tables."""

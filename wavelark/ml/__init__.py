"""Models on feature vectors."""

"""gradus: evaluation and audit analytics for ordinal predictions, on Spark."""

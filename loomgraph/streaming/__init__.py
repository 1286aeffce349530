"""Change batches to index updates."""

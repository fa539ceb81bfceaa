"""Streams: idempotent micro-batches over the same folds as in batch."""

"""Batch-wise entry: snapshots that arrive as files go through the same steps as a whole run."""

"""Incremental forms of the batch summaries. An extension: nothing here is needed for a batch result."""

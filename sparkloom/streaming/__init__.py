"""Counters, status machines and deduplication over batches or streams."""

"""Readers and writers: folders, registries, sidecars, CSV tables, subgraph transactions, exports."""

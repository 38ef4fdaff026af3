"""Column functions: spans of patterns, checksums, windows of context, geometry."""

"""Column functions: keys, tagged values, checksums and filter sizes."""

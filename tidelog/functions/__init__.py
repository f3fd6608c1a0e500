"""Column expressions: keys, hashes, spatial blocks, visibility masks."""

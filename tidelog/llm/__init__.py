"""Training-data operators: deduplication, filtering, scoring, packing and binary output.

Nothing outside this folder imports it."""

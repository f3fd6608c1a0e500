"""A Spark-native engine for declared tables whose state comes from an append-only change log."""

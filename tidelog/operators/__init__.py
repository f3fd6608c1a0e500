"""Change-log, visibility, aggregation, partitioning and schema operators as DataFrame transformations."""

"""The SQL subset: parser, analyzer and the plan as a DataFrame."""

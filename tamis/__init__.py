"""tamis: a PySpark engine that turns feeds of text records into ranked, deduplicated, explainable lists."""

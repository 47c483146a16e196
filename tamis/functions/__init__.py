"""Column functions: everything here takes and returns Spark columns and stays in generated code."""

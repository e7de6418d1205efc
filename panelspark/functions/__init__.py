"""Column functions: DataFrame-free expressions that stay inside code generation."""

"""Column builders: expressions that stay inside whole-stage code generation."""

"""Column expressions; all run inside whole-stage codegen."""

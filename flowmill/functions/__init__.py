"""Column expressions: everything here runs inside whole-stage codegen."""

"""Column expressions: no joins, no shuffles, all inside whole-stage codegen."""

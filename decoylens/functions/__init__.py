"""Column expressions: entropy, scalars, label rules and fixed vocabularies."""

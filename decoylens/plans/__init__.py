"""The registered queries: adapters over the given tables, the catalogue, and its SQL twins."""

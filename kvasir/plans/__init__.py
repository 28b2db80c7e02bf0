"""Named queries: each binds operators to the tables of a directory."""

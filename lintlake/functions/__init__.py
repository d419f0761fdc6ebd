"""Column-level building blocks: text and match positions, paths, templates, row numbers."""

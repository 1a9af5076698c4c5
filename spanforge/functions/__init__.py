"""Column functions: text, predicates and scores, geometry, table grids."""

"""DuckDB SQL that states the expected result of the catalog queries on the given tables."""

"""Named queries per operator family and the DuckDB SQL each one is checked against."""

"""DataFrame operators built on the column expressions."""

"""Named query plans over the driver tables, their DuckDB oracles and fixtures."""

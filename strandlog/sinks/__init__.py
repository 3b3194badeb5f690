"""Writers of tables, and statistics of runs."""

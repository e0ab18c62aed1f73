"""Pages made as requests come in."""

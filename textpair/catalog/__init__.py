"""Named queries over the shared test tables, with the SQL they must equal."""

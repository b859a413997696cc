"""Query catalog and SQL oracle."""

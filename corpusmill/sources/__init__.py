"""Reading tables, files and messages as documents."""

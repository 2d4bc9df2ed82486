"""Reading tables, configuration and messages; writing tables and messages."""

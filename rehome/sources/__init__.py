"""Reading landed records, tables and store listings."""

"""Follow-up actions as tables: one row for each action, with the request body as text."""

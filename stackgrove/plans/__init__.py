"""Named queries and reports."""

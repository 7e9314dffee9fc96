"""Publication sources."""

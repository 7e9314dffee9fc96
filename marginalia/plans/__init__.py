"""Pass-through SQL, staged commits and the catalogue of queries."""

"""inkspark."""

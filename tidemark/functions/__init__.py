"""See the README for an overview."""

"""plinth subpackage."""

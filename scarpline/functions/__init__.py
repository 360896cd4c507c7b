"""See README.md for the operators of this subpackage."""

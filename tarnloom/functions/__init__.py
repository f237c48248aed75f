"""Part of tarnloom; see the package docstring."""

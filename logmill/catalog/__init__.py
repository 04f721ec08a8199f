"""Known log systems."""

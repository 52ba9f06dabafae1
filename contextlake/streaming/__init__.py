"""streaming of contextlake."""

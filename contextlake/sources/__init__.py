"""sources of contextlake."""

"""operators of contextlake."""

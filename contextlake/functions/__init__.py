"""functions of contextlake."""

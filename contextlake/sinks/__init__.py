"""sinks of contextlake."""

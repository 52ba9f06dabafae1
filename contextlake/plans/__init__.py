"""plans of contextlake."""

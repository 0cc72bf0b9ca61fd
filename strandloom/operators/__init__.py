"""DataFrame operators: intervals, variants, coverage windows."""

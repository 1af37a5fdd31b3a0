"""DataFrame-to-DataFrame operators, grouped by business area."""

"""DataFrame-to-DataFrame operators of the life-cycle analysis."""

"""DataFrame-in, DataFrame-out timeline operators."""

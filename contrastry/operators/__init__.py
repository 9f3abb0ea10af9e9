"""DataFrame-in, DataFrame-out operators; keys, columns and thresholds are arguments."""

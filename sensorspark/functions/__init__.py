"""Column helpers, ordered scans and tail probabilities."""

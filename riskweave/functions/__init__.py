"""riskweave."""

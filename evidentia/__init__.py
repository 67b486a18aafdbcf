"""Evidence analytics on Spark: composable DataFrame operators with provenance."""

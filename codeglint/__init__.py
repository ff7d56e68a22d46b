"""Source-code audit analytics on Spark: findings, code graphs, taint, telemetry and retrieval as DataFrame queries."""

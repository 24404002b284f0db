"""Discussion and claim-graph analytics as Spark DataFrame jobs."""

"""Security-audit analytics for coding agents, written as Spark DataFrame jobs."""

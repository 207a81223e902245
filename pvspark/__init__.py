"""Archive and analytics for control-system signals, as Spark DataFrame jobs."""

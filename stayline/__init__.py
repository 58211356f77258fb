"""stayline: event cohorts and feature tables as Spark DataFrame jobs."""

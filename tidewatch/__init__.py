"""tidewatch: session-signal analytics and corpus operators as Spark DataFrame jobs."""

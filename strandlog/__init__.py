"""Lock-trace and coverage analytics as Spark DataFrame jobs."""

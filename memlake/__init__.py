"""memlake: agent-memory analytics as lazy Spark DataFrame plans."""

"""corrolla: panel, correlation-network and signal analytics as Spark plans."""

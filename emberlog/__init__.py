"""Detection analytics over event logs, as Spark plans."""

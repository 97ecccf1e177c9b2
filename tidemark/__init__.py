"""Event logs, revisioned state and keyed job fleets as Spark DataFrame plans."""

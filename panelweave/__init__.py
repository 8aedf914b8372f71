"""Panel, event-text and trade-signal analytics expressed as Spark DataFrame plans."""

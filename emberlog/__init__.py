"""Combat-log analytics on Spark."""

"""Entity-keyed document retrieval and evidence analytics on Spark."""

"""siltmill: retrieval-corpus analytics and record curation as Spark DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

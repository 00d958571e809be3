"""Content moderation analytics as Spark DataFrame operators."""

"""Conversation analytics expressed as Spark DataFrame transformations."""

"""Conversation, retrieval, evaluation and evidence operators as Spark DataFrame plans."""

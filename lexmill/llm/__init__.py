"""Operators on text for training-data pipelines; nothing else imports this."""

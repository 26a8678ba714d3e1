"""Operators for preparing training data; nothing else imports this package."""

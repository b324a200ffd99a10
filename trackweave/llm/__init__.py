"""Training-data pipeline operators (self-contained; nothing else imports this)."""

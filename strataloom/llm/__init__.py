"""Operators of large-scale training-data pipelines; nothing else imports them."""

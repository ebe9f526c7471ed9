"""Operators for training-data pipelines: search, scans, language models, tokens, near copies, filters, chats."""

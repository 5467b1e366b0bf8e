"""Operators for training data: tokens, languages, duplicates, search, chats, mixing, secrets.

Nothing else in the library imports this subpackage.
"""

"""Operators that turn a raw crawl into training data; nothing else in the library imports them."""

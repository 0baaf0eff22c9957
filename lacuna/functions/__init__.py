"""Column helpers: text, tokens, places."""

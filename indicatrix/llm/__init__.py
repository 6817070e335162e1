"""Training-data operators: personal data, duplicates, toxicity, language, secrets, chat, leaks, tokens."""

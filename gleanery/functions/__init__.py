"""Column functions: text, label distributions, prompts."""

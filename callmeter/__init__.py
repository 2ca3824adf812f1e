"""Usage analytics for AI coding assistants, as DataFrame operators."""

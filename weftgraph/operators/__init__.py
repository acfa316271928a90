"""Graph and relational operators."""

"""Plans compiled from selectors."""

"""Analytics over logs of timestamped interactions: history, features, candidate sets, fusion and ranking metrics."""

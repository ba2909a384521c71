"""Plans built ahead of the optimizer: metadata answers, slice pruning, statistics."""

"""Driver-side planning over metadata: keys, ordering, pruning, caps, documents."""

"""Table operators: normalise, split, sweep, frontier, features."""

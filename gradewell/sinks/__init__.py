"""File sinks for comparison, evaluation and summary outputs (O-53..O-55)."""

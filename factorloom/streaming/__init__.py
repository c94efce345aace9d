"""Following a run while it writes: the engine's only stream."""

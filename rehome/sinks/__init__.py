"""Writing snapshots, moving objects and loading tables."""

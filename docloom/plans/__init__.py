"""Named, runnable queries over the supplied tables."""

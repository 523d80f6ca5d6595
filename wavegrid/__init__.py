"""wavegrid: interval scoring of recordings, and more, as Spark plans."""

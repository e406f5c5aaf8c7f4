"""runweave.sources."""

"""runweave.streaming."""

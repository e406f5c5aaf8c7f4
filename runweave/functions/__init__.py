"""runweave.functions."""

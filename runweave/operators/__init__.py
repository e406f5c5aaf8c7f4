"""runweave.operators."""

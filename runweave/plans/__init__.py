"""runweave.plans."""

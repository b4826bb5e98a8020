"""The reference has no streaming operator, so there is none here; batches append through operators.versions."""

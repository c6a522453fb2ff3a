"""The same analyses over files as they arrive."""

"""Column functions: binary fields, text and classifiers."""

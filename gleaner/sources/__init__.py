"""File sources, corpus writers and model artifacts."""

"""Rule language and its compilation to DataFrame plans."""

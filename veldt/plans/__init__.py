"""Rule catalogues and their compilation to plans."""

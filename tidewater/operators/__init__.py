"""Operators: lazy DataFrame-to-DataFrame functions, one module per family."""

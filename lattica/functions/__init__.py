"""Column builders: quantizers, token layouts, scalar formulas."""

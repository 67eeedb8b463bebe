"""Scalar and array functions as Column expressions; Arrow UDFs where built-ins have no equivalent."""

"""Parameters with validation, whole read-outs put together from operators, and registered queries."""

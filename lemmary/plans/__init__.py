"""Rule compiler, table bindings and registered queries."""

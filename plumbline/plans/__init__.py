"""Complete runs that combine operators, and the registered queries."""

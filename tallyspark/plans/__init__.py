"""Query plans: the registered queries and the session they run in."""

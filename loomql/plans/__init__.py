"""References, rendering, plans, risk rules and policies."""

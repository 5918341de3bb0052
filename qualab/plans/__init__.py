"""Named query plans: fixture views and the registry of checked queries."""

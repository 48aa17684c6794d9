"""Independent SQL for the catalogue's queries, run by another engine on the same tables."""

"""URL lists, page tables, rule tables and output tables."""

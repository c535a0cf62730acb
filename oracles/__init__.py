"""Independent SQL answers for the registered queries, over the same test tables."""

"""Readers and writers: landed pages, record files, bundles, optional sources; gated, keyed and seeded writes."""

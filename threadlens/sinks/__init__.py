"""Writers: typed table, CSV tables, rebuilt threads, annotation lists."""

"""Fixed reference values and loaders for gene-set tables."""

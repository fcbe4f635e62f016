"""Assay sources, the loader registry and the derived-table cache."""

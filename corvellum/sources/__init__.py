"""Readers that turn matrix, panel and gene-set files into long tables."""

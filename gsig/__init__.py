"""Genomic-signal analytics as lazy Spark plans over tables keyed by contig and position."""

"""Haplotype and genotype analytics expressed as Spark plans."""

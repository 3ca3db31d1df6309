"""The registered queries of the genotype operators."""

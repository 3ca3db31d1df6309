"""DataFrame operators over reads, markers and haplotypes."""

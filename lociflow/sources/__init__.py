"""Tables, and genotype-shaped views of whole tables: the provided tables hold no genotypes of their own."""

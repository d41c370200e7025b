"""One- and two-locus heterozygosity statistics on Spark DataFrames."""

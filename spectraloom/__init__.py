"""spectraloom: mass-spectrometry analytics on Spark DataFrames."""

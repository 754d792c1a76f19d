"""Forest-notice biomass analytics on Spark DataFrames."""

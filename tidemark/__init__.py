"""tidemark — audience, campaign, calibration, sequential-test and story analytics on Spark DataFrames."""

"""Reading and writing tiers, samples and the demo tables."""

"""Evidence reconciliation over keyed and interval data, on Spark DataFrames."""

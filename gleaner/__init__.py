"""Analysis of crawled web data on Spark."""

"""The test tables seen as a job market, with queries and their SQL."""

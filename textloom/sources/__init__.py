"""Reading items from text and delimited files, and keeping the results of runs."""

"""Ready-made plans over the tables: the catalog of queries, the search facade and the command line."""

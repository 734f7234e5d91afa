"""Jobs to run over given tables: each has a function that takes a session, a config file and a command line."""

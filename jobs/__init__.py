"""Jobs that a lab runs on its library of records: each has a command line, a config file and a function that takes a session."""

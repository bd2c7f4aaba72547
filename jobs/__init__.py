"""Jobs that run from the command line; each is a function of a session and paths."""

"""Runnable jobs over the engine: each is a function of a session and paths, with a command line and a config file."""

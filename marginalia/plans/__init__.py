"""What the command line does, as functions that return plans."""

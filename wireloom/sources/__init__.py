"""Where graphs come from and go to: JSON files, driver tables, generators, DOT text."""

"""Part of termlake; see README.md."""

"""Column expressions over paths, partition names, time texts and tags."""

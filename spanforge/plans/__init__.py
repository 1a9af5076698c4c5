"""Plans: operators composed end to end."""

"""Named queries over the standard tables, each with the SQL it is checked against where SQL can say it."""

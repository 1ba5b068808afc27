"""Named queries over the tables of a folder, each next to the SQL that gives the same rows."""

"""Part of the DataFrame operator library; see README.md."""

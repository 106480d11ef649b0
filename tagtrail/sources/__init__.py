"""Reading of the index's tables and of source trees; writing of the store."""

"""Named queries over the standard tables, with their equivalent SQL where there is one."""

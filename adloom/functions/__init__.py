"""Functions of the click-through-rate warehouse."""

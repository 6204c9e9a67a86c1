"""Functions of the engine; see the README."""

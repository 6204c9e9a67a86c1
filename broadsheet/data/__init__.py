"""Tables that functions read."""

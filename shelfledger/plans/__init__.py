"""Jobs over a lake: each one handles a whole range of days at once."""

"""Where comments come from."""

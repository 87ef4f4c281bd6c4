"""Session, durability and query wiring."""

"""Organisation plans and reviewable action tables."""

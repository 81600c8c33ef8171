"""Table functions over files."""

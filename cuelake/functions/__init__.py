"""Column functions: time codes, mixed-script text, request parsing."""

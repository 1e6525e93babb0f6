"""Column functions: text, numbers and dates in the dialects that document data needs."""

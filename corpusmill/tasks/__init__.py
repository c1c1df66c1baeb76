"""What differs between tasks."""

"""Small graphs as text: layered drawing, and reading drawings back. Runs on the driver; graphs here are arguments, not data."""

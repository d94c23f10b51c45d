"""Reading surveys and writing results."""

"""Complete analyses: frames in, result tables out."""

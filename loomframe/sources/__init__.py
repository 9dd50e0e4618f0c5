"""Where frames come from: other libraries, files, and generators."""

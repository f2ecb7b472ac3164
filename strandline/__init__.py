"""Timeline and text analytics as DataFrame programs."""

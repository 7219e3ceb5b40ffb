"""Sources: channel specifications and channel export files."""

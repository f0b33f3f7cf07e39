"""Change streams over notes: debounce, polling, and per-file synchronisation in batches."""

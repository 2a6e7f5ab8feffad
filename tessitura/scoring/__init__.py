"""Model scoring in Arrow workers: one session for each model and worker process."""

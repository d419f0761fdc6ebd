"""One module per family of checks, plus scoring, trends, report, prompt, patch and project jobs."""

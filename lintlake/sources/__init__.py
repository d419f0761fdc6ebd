"""Readers that produce the canonical ``files(repo, path, content, size)`` table and its companions."""

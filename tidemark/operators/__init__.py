"""DataFrame operators over mutations and file metadata."""

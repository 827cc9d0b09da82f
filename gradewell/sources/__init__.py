"""Sources: driver tables, JSONL examples, split folders, prompt files, images (O-1..O-8)."""

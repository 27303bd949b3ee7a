"""Operators for building training corpora: tokens, near-duplicates, chat, HTML, URLs, quality, toxicity, mixing."""

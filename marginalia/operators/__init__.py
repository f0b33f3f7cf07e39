"""Relational operators over notes, state, links and remote pages."""

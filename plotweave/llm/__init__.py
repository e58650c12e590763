"""Operators for preparing training text: deduplication, decontamination, filters, token counts and packing."""

"""Operators for preparing training data: near-duplicates, seen keys, text quality, personal
details, residue of templates, leaked test passages, mixtures and repetition.

Nothing else in the library imports this package.
"""

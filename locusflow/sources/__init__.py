"""Readers of FASTA, GTF, metadata tables, gene lists and completion records."""

"""Extensions beyond the batch operators: streams of GTF files and of loci."""

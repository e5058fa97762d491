"""Column expressions: words, stems, similarity, vectors."""

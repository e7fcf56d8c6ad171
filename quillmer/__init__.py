"""quillmer: k-mer sketches, similarity and containment as Spark DataFrames."""

"""tallycell: single-cell expression analytics as Spark DataFrame operators.

Counts are one long table ``(cell_id, gene_id, count)`` holding non-zero rows only; cells, genes,
embeddings and graphs are tables beside it.  Every operator takes DataFrames and returns DataFrames.
"""

__version__ = "0.1.0"

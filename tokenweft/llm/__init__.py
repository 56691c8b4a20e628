"""Training-data operators: quality, language-model scoring, near duplicates, packing, stores, tokenisation.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; where Python
is needed it runs in Arrow batches on the executors, with memory bounded by a batch and not by the table.
"""

"""reasonloop: Spark-native data engine for self-training on reasoning problems.

Layout: ``functions`` (Column builders: answers, prompts, records, text), ``operators``
(DataFrame -> DataFrame steps: selection, report, batches, generate, ordinal),
``sources`` (JSONL I/O, splits), ``plans`` (fixture tables, one iteration, the iterative
loop), ``streaming`` (micro-batch self-training pass).
"""

__version__ = "0.1.0"

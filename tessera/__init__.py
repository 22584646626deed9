"""tessera: a Spark-native engine for registers of technical evidence.

Statements, sources, quantities and pairs are read from the register's tables; operators over them are
DataFrame expressions that Catalyst plans, with Arrow batches only where a rule cannot be written as a
column.  ``functions`` holds columns, ``operators`` relations, ``sources`` and ``streaming`` what comes in,
``plans`` queries with the SQL that says the same, ``llm`` operators for training data.
"""

__version__ = "0.2.0"

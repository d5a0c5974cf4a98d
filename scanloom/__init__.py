"""scanloom: a PySpark-native engine that prepares scanned and textual documents.

Layers, lowest first: ``functions`` (column expressions), ``kernels`` (NumPy page
kernels), ``sources`` (readers, writers, file consolidation), ``operators``
(DataFrame to DataFrame), ``plans`` (modes, chains, shared storage), ``streaming``.
The subpackage ``llm`` holds the corpus operators; nothing else imports it.
"""

__version__ = "0.1.0"

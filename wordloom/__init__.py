"""wordloom: a Spark-native engine for word-embedding corpora.

The core (``config``, ``sources``, ``functions``, ``operators``, ``plans``,
``streaming``) never imports the optional subpackage ``wordloom.llm``.
"""

__version__ = "0.1.0"

"""Training-data operators: ten text, embedding and page operators for corpus pipelines.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered ``opN_*`` queries and their SQL; every other module is one operator.
"""

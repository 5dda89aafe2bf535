"""Operators for preparing training text; nothing else in the package imports them."""

from pyspark import cloudpickle

# Code sent to Python workers travels with the job, so that executors need
# numpy, pyarrow and the named codecs but not this package.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["llm"]))

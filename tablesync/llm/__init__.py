"""Operations of a training-data pipeline: packing, dedup, chat formatting, language, URL, toxicity and benchmark filters."""

import sys

from pyspark import cloudpickle

# Python workers get the code of this package with their tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

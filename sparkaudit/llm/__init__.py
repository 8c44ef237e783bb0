"""Operations of a training-data pipeline over documents, pages and embeddings; nothing else in the library imports them."""
import sys

from pyspark import cloudpickle

# task functions travel with their helpers, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operations of a training-data pipeline over documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# tasks get the functions of this package with the job, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

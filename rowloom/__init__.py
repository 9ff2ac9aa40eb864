"""Labelled entity tables and text-line corpora, prepared for modelling on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
